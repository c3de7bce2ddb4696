"""What a listing's JSON declares: hours, duration, mode, level, language, pay; and its precedence over what texts say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enrich import declared_pay
from .text import contract, contract_of, first_match, level, skills_in, work_mode
from .vocabulary import DECLARED, INTERVALS, LANGUAGE_CODES, LANGUAGE_PATHS


def value_at(json: Column, path: str) -> Column:
    return F.lower(F.btrim(F.get_json_object(json, path)))


def single(value: Column) -> Column:
    """The one value of a JSON list or of a plain string, with underscores for blanks and dashes; null on several."""
    listed = F.from_json(value, "array<string>")
    alone = F.when(value.startswith("["), F.when(F.size(F.array_distinct(listed)) == 1, listed[0])).otherwise(value)
    return F.translate(alone, " -", "__")


def tested(value: Column, how: str, results: dict[str, str]) -> Column:
    """The result of the first key that ``value`` is, has, starts with or ends with; ``only``: is, of a list of one."""
    value = single(value) if how == "only" else value
    tests = {"is": lambda k: value == k, "only": lambda k: value == k, "has": lambda k: F.contains(value, F.lit(k)), "starts": lambda k: value.startswith(k), "ends": lambda k: value.endswith(k)}
    out = F.lit(None).cast("string")
    for key, result in reversed(results.items()):
        out = F.when(tests[how](key), result).otherwise(out)
    return out


def declared(field: str, platform: Column, json: Column) -> Column:
    """``field`` (hours, duration, mode or level) as the listing's platform declares it; null where it does not say."""
    by_platform: dict[str, list[Column]] = {}
    for name, path, how, results in DECLARED[field]:
        by_platform.setdefault(name, []).append(tested(value_at(json, path), how, results))
    for name, extra in (("francetravail", weekly_hours(json)),) if field == "hours" else (("francetravail", experience(json)),) if field == "level" else ():
        by_platform[name].append(extra)
    out = F.lit(None).cast("string")
    for name, found in by_platform.items():
        out = F.when(platform == name, F.coalesce(*found)).otherwise(out)
    return out


def weekly_hours(json: Column) -> Column:
    """Full time from 35 hours a week, part time under 30; null in between."""
    hours = F.nullif(F.regexp_extract(value_at(json, "$.dureeTravailLibelle"), r"([0-9]{1,2})h/semaine", 1), F.lit("")).try_cast("int")
    return F.when(hours >= 35, "full_time").when(hours < 30, "part_time")


def experience(json: Column) -> Column:
    """Junior under two years of experience asked for, mid under five, else senior."""
    text = value_at(json, "$.experienceLibelle")
    part = lambda n: F.nullif(F.regexp_extract(text, r"([0-9]+)\s*(an|mois)", n), F.lit(""))
    years = part(1).try_cast("double") / F.when(part(2) == "mois", 12).otherwise(1)
    return F.when(years < 2, "junior").when(years < 5, "mid").when(years.isNotNull(), "senior")


def declared_language(platform: Column, json: Column) -> Column:
    """The two-letter code that a platform declares, without its region; null for unknown codes."""
    out = F.lit(None).cast("string")
    for name, path in LANGUAGE_PATHS.items():
        code = F.regexp_extract(value_at(json, path), "^([a-z]+)", 1)
        out = F.when((platform == name) & code.isin(*LANGUAGE_CODES), code).otherwise(out)
    return out


def stated_mode(json: Column) -> Column:
    """Work mode by the common keys of a listing's JSON."""
    workplace, yes = value_at(json, "$.workplaceType"), ("true", "1")
    remote = value_at(json, "$.is_remote").eqNullSafe("true") | F.coalesce(value_at(json, "$.remote").isin(*yes), F.lit(False)) | value_at(json, "$.remote_only").eqNullSafe("true")
    return F.when(workplace.isin("remote", "hybrid", "onsite"), workplace).when(remote, "remote")


def facts(platform: Column, json: Column, title: Column, place: Column, text: Column, skills: list[str], most: int = 20) -> Column:
    """struct(level, mode, contract, skills): what is declared wins over the JSON's common keys, these over title and text."""
    short = F.concat_ws(" ", title, place)
    return F.struct(
        F.coalesce(declared("level", platform, json), level(title)).alias("level"),
        F.coalesce(declared("mode", platform, json), stated_mode(json), work_mode(short)).alias("mode"),
        F.coalesce(contract_of(json), declared("hours", platform, json), contract(title)).alias("contract"),
        skills_in(F.concat_ws("\n", title, text), skills, most).alias("skills"),
    )


def pay_range(json: Column, path: str, interval: str | None = None) -> Column:
    """struct(low, high, currency, period) of an object with min, max and currency; null without a currency or an amount."""
    amount = lambda key: F.get_json_object(json, f"{path}.{key}").try_cast("double")
    sane = lambda v: F.when((v > 0) & (v < 10_000_000), v)
    low, high = sane(amount("min")), sane(amount("max"))
    currency = F.nullif(F.upper(F.get_json_object(json, f"{path}.currency")), F.lit(""))
    told = value_at(json, f"{path}.{interval}") if interval else F.lit(None).cast("string")
    period = first_match(told, [(f"^{k}$", v) for k, v in INTERVALS.items()])
    whole = F.struct(F.coalesce(low, high).alias("low"), F.coalesce(high, low).alias("high"), currency.alias("currency"), period.alias("period"))
    return F.when(F.coalesce(low, high).isNotNull() & currency.isNotNull(), whole)


def structured_pay(json: Column, country: Column, parsed: Column) -> Column:
    """Pay of a listing's JSON, the first of: a salary range, a salary object, a pay string, a schema.org base salary.

    ``parsed`` is the struct that ``udfs.field_salary`` gives for ``pay_string(json)``.
    """
    string = F.when(parsed["low"].isNotNull(), F.struct(*(parsed[c].alias(c) for c in ("low", "high", "currency", "period"))))
    return F.coalesce(pay_range(json, "$.salaryRange", "interval"), pay_range(json, "$.salary_range", "interval"), pay_range(json, "$.salary"), string, declared_pay(F.get_json_object(json, "$.baseSalary"), country))


def pay_string(json: Column) -> Column:
    """The pay field that is a string: salary, else compensation."""
    plain = lambda path: F.when(~F.get_json_object(json, path).rlike(r"^\s*([\[{]|$)"), F.get_json_object(json, path))
    return F.coalesce(plain("$.salary"), plain("$.compensation"))
