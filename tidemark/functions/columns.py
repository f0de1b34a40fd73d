"""Column-level helpers.  All return ``Column`` expressions built from Spark
built-ins, so they stay inside whole-stage codegen (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
RISK_HIGH = 0.60  # score >= 0.60 -> high (inclusive)
RISK_MEDIUM = 0.30  # score >= 0.30 -> medium, else low
RISK_BANDS = ("high", "medium", "low")
GEOS = ("NA", "EMEA", "APAC", "LATAM", "MEA", "ANZ")
SUBSCRIBED_STATUSES = ("active", "downgraded")
TREND_FLAT_LO = 0.97  # trend direction dead-band
TREND_FLAT_HI = 1.03
SEVERITY_HIGH = 3.7  # regional churn % severity cut-offs
SEVERITY_MEDIUM = 3.3
USER_ID_PATTERN = r"^[A-Za-z0-9_-]{1,64}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_band(score, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    """``>= high`` -> 'high', ``>= medium`` -> 'medium', else 'low'."""
    s = _c(score)
    return F.when(s >= F.lit(high), "high").when(s >= F.lit(medium), "medium").otherwise("low")


def norm_band(band) -> Column:
    """Lower-case; anything not a known band (incl. NULL) -> 'low'."""
    b = F.lower(_c(band))
    return F.when(b.isin(*RISK_BANDS), b).otherwise("low")


def coerce_num(value, default: float = 0.0) -> Column:
    """NULL, '' or non-numeric -> ``default`` (NaN/inf also fall back)."""
    num = _c(value).cast("string").try_cast("double")
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf")))
    return F.when(finite, num).otherwise(F.lit(float(default)))


def is_subscribed(status) -> Column:
    """Status in (active, downgraded); NULL when there is no term."""
    return _c(status).isin(*SUBSCRIBED_STATUSES)


def trend_direction(ratio) -> Column:
    """P8: 'dn' below 0.97, 'up' above 1.03, else 'flat'."""
    r = _c(ratio)
    return F.when(r < F.lit(TREND_FLAT_LO), "dn").when(r > F.lit(TREND_FLAT_HI), "up").otherwise("flat")


def trend_label(ratio) -> Column:
    """P8 magnitude: 'flat' inside the dead-band, else ``abs(round((r-1)*100))%``.

    ``round`` is half away from zero on the decimal form (Spark semantics)."""
    r = _c(ratio)
    mag = F.abs(F.round((r - F.lit(1.0)) * 100, 0)).cast("bigint").cast("string")
    inside = (r >= F.lit(TREND_FLAT_LO)) & (r <= F.lit(TREND_FLAT_HI))
    return F.when(inside, F.lit("flat")).otherwise(F.concat(mag, F.lit("%")))


def severity(churn_pct) -> Column:
    """Regional churn % severity."""
    p = _c(churn_pct)
    return F.when(p >= F.lit(SEVERITY_HIGH), "high").when(p >= F.lit(SEVERITY_MEDIUM), "medium").otherwise("low")


def pct2(x) -> Column:
    """P10: share -> percent rounded to 2 dp."""
    return F.round(_c(x) * 100, 2)


def safe_divide(num, den) -> Column:
    """NULL instead of a division-by-zero error (ANSI mode)."""
    return F.try_divide(_c(num), _c(den))


def valid_user_id(col) -> Column:
    return _c(col).rlike(USER_ID_PATTERN)


#: wrapping quotes of an answer, fixed values
QUOTES = "\"'“”‘’"
#: the note on its result's rows that an answer may end with, fixed words
ROWS_NOTE = r"(?i)[,;]?\s*(?:across|in|based on|over|from)\s+(?:all\s+)?[0-9]+\s+rows?(?:\s+\w+){0,2}(\.?)\s*$"


def clean_text(col, max_len: int = 520) -> Column:
    """TX1: an answer as plain text of at most two sentences.

    White space is collapsed, wrapping quotes and paired emphasis marks go
    (a mark without its pair stays, as in ``user_id``), and so does a closing
    "across N rows shown".  Longer answers end at their last sentence end
    within ``max_len``, or, where that is too early, with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s+", " "))
    t = F.trim(F.regexp_replace(t, f"^[{QUOTES}]+|[{QUOTES}]+$", ""))
    for mark in (r"\*\*", "__", r"\*", "_"):
        t = F.regexp_replace(t, f"{mark}(.+?){mark}", "$1")
    t = F.regexp_replace(t, ROWS_NOTE, "$1")
    t = F.trim(F.regexp_replace(t, r"\s+([.!?])", "$1"))
    sentences = F.regexp_extract_all(t, F.lit("[^.!?]+[.!?]+"), F.lit(0))
    two = F.concat_ws(" ", F.trim(F.get(sentences, 0)), F.trim(F.get(sentences, 1)))
    t = F.when(F.size(sentences) > 2, two).otherwise(t)
    cut = F.substring(t, 1, max_len)
    back = F.reverse(cut)
    # a sentence end followed by a blank: the first such pair from the back
    ends = [F.when(F.instr(back, f" {mark}") > 0, F.length(cut) - F.instr(back, f" {mark}")).otherwise(0) for mark in ".!?"]
    stop = F.greatest(*ends)
    short = F.when(stop > int(max_len * 0.4) + 1, F.substr(cut, F.lit(1), stop)).otherwise(F.concat(F.rtrim(cut), F.lit("…")))
    return F.when(F.length(t) > max_len, short).otherwise(t)


def half_up_ratio(num, den) -> Column:
    """Exact ``round_half_up(num / den)`` for non-negative integers:
    ``(2 num + den) div (2 den)`` in whole DECIMAL(38, 0) numbers, so neither a
    double's 53 bits nor a BIGINT's range bounds the operands; NULL where
    ``den`` is 0.  The quotient itself must fit a BIGINT."""
    n, d = _c(num).cast("decimal(36,0)"), _c(den).cast("decimal(36,0)")
    two = F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", two * n + d, F.nullif(two * d, F.lit(0).cast("decimal(1,0)")))


def scaled_int(col, digits: int) -> Column:
    """A value with ``digits`` decimals as an exact integer (x * 10^digits)."""
    return F.round(_c(col) * F.lit(10**digits), 0).cast("bigint")


def exact_mean(col, in_digits: int, out_digits: int = 4) -> Column:
    """Mean of fixed-decimal values rounded half-up to ``out_digits``, exactly:
    integer sum of scaled values, integer half-up division, one final scale."""
    s = F.sum(scaled_int(col, in_digits).cast("decimal(19,0)"))
    n = F.count(_c(col))
    up = 10 ** max(out_digits - in_digits, 0)
    down = 10 ** max(in_digits - out_digits, 0)
    return half_up_ratio(s.cast("decimal(30,0)") * F.lit(up), n * F.lit(down)) / F.lit(float(10**out_digits))
