"""Dates: tolerant parsing, buckets, ranges and what a question says about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms besides ISO 8601, tried in order.
OTHER_FORMS = ("yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parsed(text: Column) -> Column:
    """A timestamp without zone: ISO 8601 (a zone is applied, then dropped at UTC), then slash forms with or without a day name."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r" \([A-Za-z]{3}\)", "")
    zoned = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(t).cast("timestamp_ntz"))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"), F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" "))).cast("timestamp_ntz"))
    forms = [F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in OTHER_FORMS]
    return F.coalesce(zoned, iso, *forms)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def prompt_date(ts: Column) -> Column:
    """The date alone at midnight, else with the time; empty for NULL."""
    return F.when(ts.isNull(), "").when(F.date_format(ts, "HH:mm:ss") == "00:00:00", F.date_format(ts, "yyyy-MM-dd")).otherwise(iso_seconds(ts))


def month_bucket(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def day_range(ts: Column) -> Column:
    day = F.to_date(ts)
    return F.struct(day.alias("start"), F.date_add(day, 1).alias("end"))


def years_in(text: Column) -> Column:
    """Years 1900-2099 that stand as words."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(F.filter(runs, lambda w: w.rlike("^(19|20)[0-9]{2}$")), lambda w: w.cast("int"))


def months_in(text: Column) -> Column:
    """Month numbers of month names and their short forms that stand as words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    names = F.filter(runs, lambda w: w.rlike("^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"))
    return F.transform(names, lambda w: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(w, 1, 3)).cast("int"))


def question_range(text: Column) -> Column:
    """struct(start, end) of dates, end exclusive: an ISO day, else least year and month, else least year; NULL without."""
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    year, month = F.array_min(years_in(text)), F.array_min(months_in(text))
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    by_month = F.make_date(year, month, F.lit(1))
    by_year = F.make_date(year, F.lit(1), F.lit(1))
    return (
        F.when(iso.isNotNull(), span(iso, F.date_add(iso, 1)))
        .when(by_month.isNotNull(), span(by_month, F.add_months(by_month, 1)))
        .when(by_year.isNotNull(), span(by_year, F.add_months(by_year, 12)))
    )


def spoken(text: Column) -> Column:
    """``1:05 pm on 3 May, 2023``."""
    return F.try_to_timestamp(
        F.concat(F.upper(F.regexp_extract(text, r"^\s*(\d+:\d+ [apAP][mM]) on ", 1)), F.lit(" "), F.regexp_extract(text, r" on (.*?)\s*$", 1)), F.lit("h:mm a d MMMM, yyyy")
    ).cast("timestamp_ntz")


def anchor(text: Column) -> Column:
    """``March-15-2024``."""
    return F.try_to_timestamp(F.trim(text), F.lit("MMMM-d-yyyy")).cast("timestamp_ntz")
