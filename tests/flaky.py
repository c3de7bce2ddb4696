"""A file system whose first openings of each file fail; counts are kept in a file beside it, for all processes."""

import os

from pyarrow import fs

FAILURES = 2


class Flaky:
    def __init__(self):
        self.local = fs.LocalFileSystem()

    def get_file_info(self, what):
        return self.local.get_file_info(what)

    def open_input_file(self, path):
        with open(f"{path}.tries", "a+") as f:
            f.write("x")
            f.seek(0)
            if len(f.read()) <= FAILURES:
                raise OSError("connection reset")
        return self.local.open_input_file(path)

    open_input_stream = open_input_file


class Broken(Flaky):
    def open_input_file(self, path):
        raise OSError("gone for good")


def flaky(path):
    return Flaky(), os.path.abspath(path)


def broken(path):
    return Broken(), os.path.abspath(path)
