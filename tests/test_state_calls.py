"""The state machines call the state store a few times a bucket and batch, however many keys and rows it has."""

from types import SimpleNamespace

from larkspur.streaming import stateful

HOUR = 3_600_000_000


class Store:
    """A handle with its states, which counts calls."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def state(self, name):
        def call(f):
            def counted(*args):
                self.calls += 1
                return f(*args)

            return counted

        put = call(lambda v: self.values.__setitem__(name, v))
        return SimpleNamespace(exists=call(lambda: name in self.values), get=call(lambda: self.values.get(name)), update=put, put=put, clear=call(lambda: self.values.pop(name, None)))

    def getValueState(self, name, schema):
        return self.state(name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def deliver(machine, rows, mark):
    given = [{"user": u, "__at": at, "__tie": i, "__mark": bad} for i, (u, at, bad) in enumerate(rows)]
    return list(machine.handleInputRows((0,), iter(given), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark // 1000)))


def test_calls_do_not_grow_with_keys_or_rows():
    store, machine = Store(), stateful.Incidents(["user"], "user long", 4 * HOUR)
    machine.init(store)
    assert deliver(machine, [(user, hour * HOUR, 1) for user in range(200) for hour in range(1, 5)], 0) == []
    # opened at the second hour and due at the sixth, where half of them are resolved
    out = deliver(machine, [(user, 6 * HOUR, 0) for user in range(100)], 7 * HOUR)
    assert {e: sum(r.event == e for r in out) for e in ("opened", "resolved", "escalated")} == {"opened": 200, "resolved": 100, "escalated": 100}
    assert store.calls <= 20 and not store.timers
