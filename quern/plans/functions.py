"""Queries on the column functions: numbers, strings, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates as D
from quern.functions import elementwise as E
from quern.functions import strings as S
from quern.plans.tpch import table as T

PLANS: dict = {}


# Columns of the tables; made when a query runs, as they need a session.


def _discount():
    return F.col("l_discount")


def _quantity():
    return F.col("l_quantity")


def _price():
    return F.col("l_extendedprice")


def _orderkey():
    return F.col("l_orderkey")


def _partkey():
    return F.col("l_partkey")


def _name():
    return F.col("p_name")


def _brand():
    return F.col("p_brand")


def _ordered():
    return F.col("o_orderdate").cast("timestamp")


def _at():
    return F.col("ts").cast("timestamp")


def plan(sql: str | None):
    def put(run):
        PLANS[run.__name__] = (run, sql)
        return run

    return put


def _family(name: str, source: str, keys: list[str], digits: int, parts: dict) -> None:
    """A query of many functions, name: (column, SQL); numbers are rounded alike on both sides."""

    def run(s, d):
        rows = T(s, d, source)
        return rows.select(*keys, *[(F.round(c() + 10 ** -(digits + 3), digits) if digits else c()).alias(n) for n, (c, _) in parts.items()])

    cols = [f"round({q} + {10 ** -(digits + 3):.{digits + 3}f}, {digits}) AS {n}" if digits else f"{q} AS {n}" for n, (_, q) in parts.items()]
    run.__name__ = name
    PLANS[name] = (run, f"SELECT {', '.join(keys + cols)} FROM {source}")



LK = ["l_orderkey", "l_linenumber"]

_family("numpy_trigonometry", "lineitem", LK, 8, {
    "sin_": (lambda: E.sin(_quantity()), "sin(l_quantity)"), "cos_": (lambda: E.cos(_quantity()), "cos(l_quantity)"), "tan_": (lambda: E.tan(_discount()), "tan(l_discount)"),
    "arcsin_": (lambda: E.arcsin(_discount()), "asin(l_discount)"), "arccos_": (lambda: E.arccos(_discount()), "acos(l_discount)"), "arctan_": (lambda: E.arctan(_quantity()), "atan(l_quantity)"),
    "arctan2_": (lambda: E.arctan2(_quantity(), _price()), "atan2(l_quantity, l_extendedprice)"), "hypot_": (lambda: E.hypot(_quantity(), _discount()), "sqrt(l_quantity * l_quantity + l_discount * l_discount)"),
    "deg2rad_": (lambda: E.deg2rad(_quantity()), "radians(l_quantity)"), "rad2deg_": (lambda: E.rad2deg(_discount()), "degrees(l_discount)"), "sinc_": (lambda: E.sinc(_discount()), "CASE WHEN l_discount = 0 THEN 1.0 ELSE sin(pi() * l_discount) / (pi() * l_discount) END"),
})
_family("numpy_hyperbolic", "lineitem", LK, 8, {
    "sinh_": (lambda: E.sinh(_discount()), "sinh(l_discount)"), "cosh_": (lambda: E.cosh(_discount()), "cosh(l_discount)"), "tanh_": (lambda: E.tanh(_discount()), "tanh(l_discount)"),
    "arcsinh_": (lambda: E.arcsinh(_quantity()), "asinh(l_quantity)"), "arccosh_": (lambda: E.arccosh(_quantity()), "acosh(l_quantity)"), "arctanh_": (lambda: E.arctanh(_discount()), "atanh(l_discount)"),
})
_family("numpy_exponents_logarithms", "lineitem", LK, 7, {
    "exp_": (lambda: E.exp(_discount()), "exp(l_discount)"), "exp2_": (lambda: E.exp2(_discount()), "pow(2, l_discount)"), "expm1_": (lambda: E.expm1(_discount()), "exp(l_discount) - 1"),
    "log_": (lambda: E.log(_quantity()), "ln(l_quantity)"), "log2_": (lambda: E.log2(_quantity()), "log2(l_quantity)"), "log10_": (lambda: E.log10(_quantity()), "log10(l_quantity)"), "log1p_": (lambda: E.log1p(_discount()), "ln(1 + l_discount)"),
    "logaddexp_": (lambda: E.logaddexp(_discount(), _quantity()), "l_quantity + ln(1 + exp(l_discount - l_quantity))"), "logaddexp2_": (lambda: E.logaddexp2(_discount(), _quantity()), "l_quantity + log2(1 + pow(2, l_discount - l_quantity))"),
    "sqrt_": (lambda: E.sqrt(_price()), "sqrt(l_extendedprice)"), "cbrt_": (lambda: E.cbrt(_price()), "cbrt(l_extendedprice)"), "square_": (lambda: E.square(_discount()), "l_discount * l_discount"), "power_": (lambda: E.power(_quantity(), _discount()), "pow(l_quantity, l_discount)"),
    "float_power_": (lambda: E.float_power(_discount(), F.lit(2)), "pow(l_discount, 2)"), "reciprocal_": (lambda: E.reciprocal(_quantity()), "1 / l_quantity"), "i0_": (lambda: E.i0(_discount()), "1 + pow(l_discount / 2, 2) + pow(l_discount / 2, 4) / 4 + pow(l_discount / 2, 6) / 36 + pow(l_discount / 2, 8) / 576"),
})
_family("numpy_rounding", "lineitem", LK, 0, {
    "around_": (lambda: E.around(_quantity() / 2, 0), "round_even(l_quantity / 2, 0)"), "rint_": (lambda: E.rint(_quantity() / 2), "round_even(l_quantity / 2, 0)"), "floor_": (lambda: E.floor(_price()), "floor(l_extendedprice)"), "ceil_": (lambda: E.ceil(_price()), "ceil(l_extendedprice)"),
    "trunc_": (lambda: E.trunc(-_price()), "trunc(-l_extendedprice)"), "fix_": (lambda: E.fix(_price()), "trunc(l_extendedprice)"), "sign_": (lambda: E.sign(_quantity() - 25), "sign(l_quantity - 25)::DOUBLE"), "signbit_": (lambda: E.signbit(_quantity() - 25), "signbit(l_quantity - 25)"),
    "clip_": (lambda: E.clip(_quantity(), 10.0, 20.0), "least(greatest(l_quantity, 10), 20)"), "abs_": (lambda: E.abs_(_quantity() - 25), "abs(l_quantity - 25)"), "negative_": (lambda: E.negative(_quantity()), "-l_quantity"), "positive_": (lambda: E.positive(_quantity()), "l_quantity"),
    "copysign_": (lambda: E.copysign(_quantity(), _discount() - 0.05), "CASE WHEN l_discount - 0.05 < 0 THEN -l_quantity ELSE l_quantity END"), "spacing_": (lambda: E.spacing(_quantity()), "pow(2.0, floor(log2(l_quantity)) - 52)"),
})
_family("numpy_arithmetic", "lineitem", LK, 6, {
    "add_": (lambda: _quantity() + _discount(), "l_quantity + l_discount"), "subtract_": (lambda: _quantity() - _discount(), "l_quantity - l_discount"), "multiply_": (lambda: _quantity() * _discount(), "l_quantity * l_discount"),
    "divide_": (lambda: E.divide(_price(), _quantity()), "l_extendedprice / l_quantity"), "floor_divide_": (lambda: E.floor_divide(_price(), _quantity()), "floor(l_extendedprice / l_quantity)"),
    "mod_": (lambda: E.mod(-_quantity(), F.lit(7)), "-l_quantity - 7 * floor(-l_quantity / 7)"), "fmod_": (lambda: E.fmod(-_quantity(), F.lit(7)), "-l_quantity - 7 * trunc(-l_quantity / 7)"),
    "maximum_": (lambda: E.maximum(_quantity(), _discount() * 500), "greatest(l_quantity, l_discount * 500)"), "minimum_": (lambda: E.minimum(_quantity(), _discount() * 500), "least(l_quantity, l_discount * 500)"), "fmax_": (lambda: E.fmax(_quantity(), F.lit(30)), "greatest(l_quantity, 30)"), "fmin_": (lambda: E.fmin(_quantity(), F.lit(30)), "least(l_quantity, 30)"),
    "ldexp_": (lambda: E.ldexp(_discount(), F.lit(5)), "l_discount * 32"), "mantissa_": (lambda: E.frexp(_quantity())["mantissa"], "l_quantity / pow(2, floor(log2(l_quantity)) + 1)"), "fractional_": (lambda: E.modf(_price())["fractional"], "l_extendedprice - trunc(l_extendedprice)"), "nan_to_num_": (lambda: E.nan_to_num(F.when(_quantity() > 25, _quantity()).otherwise(float("nan"))), "CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END"),
})

_family("numpy_bits_logic", "lineitem", LK, 0, {
    "and_": (lambda: E.bitwise_and(_orderkey(), _partkey()), "l_orderkey & l_partkey"), "or_": (lambda: E.bitwise_or(_orderkey(), _partkey()), "l_orderkey | l_partkey"), "xor_": (lambda: E.bitwise_xor(_orderkey(), _partkey()), "xor(l_orderkey, l_partkey)"), "invert_": (lambda: E.invert(_orderkey()), "~l_orderkey"),
    "left_": (lambda: E.left_shift(_orderkey(), 3), "l_orderkey << 3"), "right_": (lambda: E.right_shift(_orderkey(), 2), "l_orderkey >> 2"),
    "logical_and_": (lambda: E.logical_and(_discount(), _quantity()), "l_discount <> 0 AND l_quantity <> 0"), "logical_or_": (lambda: E.logical_or(_discount(), F.col("l_tax")), "l_discount <> 0 OR l_tax <> 0"), "logical_xor_": (lambda: E.logical_xor(_discount(), F.col("l_tax")), "(l_discount <> 0) <> (l_tax <> 0)"), "logical_not_": (lambda: E.logical_not(_discount()), "l_discount = 0"),
    "greater_": (lambda: _quantity() > 25, "l_quantity > 25"), "greater_equal_": (lambda: _quantity() >= 25, "l_quantity >= 25"), "less_": (lambda: _quantity() < 25, "l_quantity < 25"), "less_equal_": (lambda: _quantity() <= 25, "l_quantity <= 25"), "equal_": (lambda: _quantity() == 25, "l_quantity = 25"), "not_equal_": (lambda: _quantity() != 25, "l_quantity <> 25"),
    "isclose_": (lambda: E.isclose(_discount(), F.lit(0.05)), "abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05"), "isfinite_": (lambda: E.isfinite(_quantity()), "isfinite(l_quantity)"), "isinf_": (lambda: E.isinf(_quantity()), "isinf(l_quantity)"), "isnan_": (lambda: E.isnan(_quantity()), "isnan(l_quantity)"),
})
_family("scipy_special", "lineitem", LK, 6, {
    "gammaln_": (lambda: E.gammaln(_quantity()), "lgamma(l_quantity)"), "gamma_": (lambda: E.gamma(_discount() + 1), "gamma(l_discount + 1)"), "betaln_": (lambda: E.betaln(_quantity(), _discount() + 1), "lgamma(l_quantity) + lgamma(l_discount + 1) - lgamma(l_quantity + l_discount + 1)"), "beta_": (lambda: E.beta(_discount() + 1, _discount() + 2), "gamma(l_discount + 1) * gamma(l_discount + 2) / gamma(2 * l_discount + 3)"),
    "xlogy_": (lambda: E.xlogy(_discount(), _quantity()), "CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount * ln(l_quantity) END"), "entr_": (lambda: E.entr(_discount()), "CASE WHEN l_discount = 0 THEN 0.0 ELSE -l_discount * ln(l_discount) END"),
    "rel_entr_": (lambda: E.rel_entr(_quantity(), _price()), "l_quantity * ln(l_quantity / l_extendedprice)"), "kl_div_": (lambda: E.kl_div(_quantity(), _price()), "l_quantity * ln(l_quantity / l_extendedprice) - l_quantity + l_extendedprice"),
    "erf_": (lambda: E.erf(_discount()), "2 / sqrt(pi()) * (l_discount - pow(l_discount, 3) / 3 + pow(l_discount, 5) / 10 - pow(l_discount, 7) / 42 + pow(l_discount, 9) / 216)"),
})


PK = ["p_partkey"]
_family("string_case", "part", PK, 0, {
    "lower_": (lambda: S.lower(_brand()), "lower(p_brand)"), "upper_": (lambda: S.upper(_name()), "upper(p_name)"), "capitalize_": (lambda: S.capitalize(_name()), "upper(p_name[1]) || lower(p_name[2:])"), "casefold_": (lambda: S.casefold(_brand()), "lower(p_brand)"),
    "len_": (lambda: S.length(_name()), "length(p_name)::INT"), "islower_": (lambda: S.islower(_name()), "p_name = lower(p_name) AND regexp_matches(p_name, '[a-zA-Z]')"), "isupper_": (lambda: S.isupper(_brand()), "p_brand = upper(p_brand) AND regexp_matches(p_brand, '[a-zA-Z]')"),
    "isalpha_": (lambda: S.isalpha(_name()), "regexp_full_match(p_name, '[A-Za-z]+')"), "isalnum_": (lambda: S.isalnum(_brand()), "regexp_full_match(p_brand, '[A-Za-z0-9]+')"), "isdigit_": (lambda: S.isdigit(_brand()), "regexp_full_match(p_brand, '[0-9]+')"), "isnumeric_": (lambda: S.isnumeric(_brand()), "regexp_full_match(p_brand, '[0-9]+')"), "isspace_": (lambda: S.isspace(_brand()), "regexp_full_match(p_brand, '\\s+')"),
})
_family("string_pad_slice", "part", PK, 0, {
    "rjust_": (lambda: S.rjust(_brand(), 12, "*"), "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '*') END"), "ljust_": (lambda: S.ljust(_brand(), 12, "*"), "CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '*') END"),
    "center_": (lambda: S.center(_brand(), 4), "p_brand"), "zfill_": (lambda: S.zfill(F.col("p_size").cast("string"), 5), "lpad(p_size::VARCHAR, 5, '0')"), "slice_": (lambda: S.slice_(_name(), 1, 4), "p_name[2:4]"), "tail_": (lambda: S.slice_(_name(), -3), "p_name[-3:]"), "get_": (lambda: S.get(_name(), 2), "p_name[3]"), "last_": (lambda: S.get(_name(), -1), "p_name[-1]"),
    "slice_replace_": (lambda: S.slice_replace(_name(), 1, 3, "--"), "p_name[1] || '--' || p_name[4:]"), "repeat_": (lambda: S.repeat(_brand(), 2), "p_brand || p_brand"), "removeprefix_": (lambda: S.removeprefix(_brand(), "Brand"), "CASE WHEN starts_with(p_brand, 'Brand') THEN p_brand[6:] ELSE p_brand END"), "removesuffix_": (lambda: S.removesuffix(_brand(), "1"), "CASE WHEN ends_with(p_brand, '1') THEN p_brand[:-2] ELSE p_brand END"),
    "strip_": (lambda: S.strip(F.concat(F.lit("  "), _brand(), F.lit(" \t"))), "p_brand"), "lstrip_": (lambda: S.lstrip(F.concat(F.lit("xyx"), _name()), "xy"), "ltrim('xyx' || p_name, 'xy')"), "rstrip_": (lambda: S.rstrip(F.concat(_name(), F.lit("..")), "."), "rtrim(p_name || '..', '.')"),
})
_family("string_search", "part", PK, 0, {
    "contains_": (lambda: S.contains(_name(), "e.*r"), "regexp_matches(p_name, 'e.*r')"), "literal_": (lambda: S.contains(_brand(), "#1", regex=False), "contains(p_brand, '#1')"), "match_": (lambda: S.match(_name(), "[a-m]"), "regexp_matches(p_name, '^[a-m]')"), "fullmatch_": (lambda: S.fullmatch(_brand(), "Brand#[0-9]+"), "regexp_full_match(p_brand, 'Brand#[0-9]+')"),
    "startswith_": (lambda: S.startswith(_brand(), "Brand#2"), "starts_with(p_brand, 'Brand#2')"), "endswith_": (lambda: S.endswith(_brand(), "3"), "ends_with(p_brand, '3')"), "find_": (lambda: S.find(_name(), "e"), "(instr(p_name, 'e') - 1)::INT"), "rfind_": (lambda: S.rfind(_name(), "e"), "(CASE WHEN instr(reverse(p_name), 'e') > 0 THEN length(p_name) - instr(reverse(p_name), 'e') ELSE -1 END)::INT"),
    "count_": (lambda: S.count(_name(), "[aeiou]"), "len(regexp_extract_all(p_name, '[aeiou]'))::INT"), "extract_": (lambda: S.extract(_brand(), "([0-9]+)"), "nullif(regexp_extract(p_brand, '([0-9]+)', 1), '')"), "findall_": (lambda: F.array_join(S.findall(_name(), "[aeiou]"), "."), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '.')"),
    "replace_": (lambda: S.replace(_name(), "e", "E"), "replace(p_name, 'e', 'E')"), "regex_": (lambda: S.replace(_name(), "[aeiou]", "_", regex=True), "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "translate_": (lambda: S.translate(_name(), {"a": "4", "e": "3"}), "translate(p_name, 'ae', '43')"),
})
_family("string_split_join", "part", PK, 0, {
    "before_": (lambda: S.partition(_brand(), "#")["before"], "split_part(p_brand, '#', 1)"), "after_": (lambda: S.partition(_brand(), "#")["after"], "split_part(p_brand, '#', 2)"), "rafter_": (lambda: S.rpartition(_brand(), "#")["after"], "split_part(p_brand, '#', -1)"),
    "parts_": (lambda: F.size(S.split(_name(), "e")), "len(string_split(p_name, 'e'))::INT"), "words_": (lambda: F.array_join(S.split(_name()), "|"), "array_to_string(regexp_extract_all(p_name, '\\S+'), '|')"), "cat_": (lambda: S.cat(_name(), _brand(), sep="/"), "p_name || '/' || p_brand"), "join_": (lambda: S.join(_brand(), "-"), "array_to_string(string_split(p_brand, ''), '-')"), "decode_": (lambda: S.decode(S.encode(_name())), "p_name"),
})


OK = ["o_orderkey"]
_family("datetime_fields", "orders", OK, 0, {
    "year_": (lambda: D.year(_ordered()), "year(o_orderdate)::INT"), "month_": (lambda: D.month(_ordered()), "month(o_orderdate)::INT"), "day_": (lambda: D.day(_ordered()), "day(o_orderdate)::INT"), "hour_": (lambda: D.hour(_ordered()), "hour(o_orderdate)::INT"), "minute_": (lambda: D.minute(_ordered()), "minute(o_orderdate)::INT"), "second_": (lambda: D.second(_ordered()), "second(o_orderdate)::INT"), "microsecond_": (lambda: D.microsecond(_ordered()), "epoch_us(o_orderdate) % 1000000"),
    "week_": (lambda: D.week(_ordered()), "week(o_orderdate)::INT"), "weekday_": (lambda: D.weekday(_ordered()), "(isodow(o_orderdate) - 1)::INT"), "dayofyear_": (lambda: D.dayofyear(_ordered()), "dayofyear(o_orderdate)::INT"), "quarter_": (lambda: D.quarter(_ordered()), "quarter(o_orderdate)::INT"), "iso_year_": (lambda: D.isocalendar(_ordered())["year"], "isoyear(o_orderdate)::INT"), "days_in_month_": (lambda: D.days_in_month(_ordered()), "day(last_day(o_orderdate))::INT"),
    "date_": (lambda: D.date(_ordered()), "o_orderdate::DATE"), "time_": (lambda: D.time(_ordered()), "strftime(o_orderdate, '%H:%M:%S')"),
})
_family("datetime_flags", "orders", OK, 0, {
    "month_start_": (lambda: D.is_month_start(_ordered()), "day(o_orderdate) = 1"), "month_end_": (lambda: D.is_month_end(_ordered()), "o_orderdate::DATE = last_day(o_orderdate)"), "quarter_start_": (lambda: D.is_quarter_start(_ordered()), "day(o_orderdate) = 1 AND month(o_orderdate) % 3 = 1"), "quarter_end_": (lambda: D.is_quarter_end(_ordered()), "o_orderdate::DATE = last_day(o_orderdate) AND month(o_orderdate) % 3 = 0"),
    "year_start_": (lambda: D.is_year_start(_ordered()), "dayofyear(o_orderdate) = 1"), "year_end_": (lambda: D.is_year_end(_ordered()), "month(o_orderdate) = 12 AND day(o_orderdate) = 31"), "leap_": (lambda: D.is_leap_year(_ordered()), "(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0"),
    "month_name_": (lambda: D.month_name(_ordered()), "monthname(o_orderdate)"), "day_name_": (lambda: D.day_name(_ordered()), "dayname(o_orderdate)"), "strftime_": (lambda: D.strftime(_ordered(), "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
})

_family("datetime_rounding", "events", ["event_id"], 0, {
    "floor_": (lambda: D.floor(_at(), "hour"), "date_trunc('hour', ts)"), "ceil_": (lambda: D.ceil(_at(), "hour"), "CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END"), "normalize_": (lambda: D.normalize(_at()), "date_trunc('day', ts)"), "period_": (lambda: D.to_period(_at(), "month"), "date_trunc('month', ts)"), "end_": (lambda: D.end_time(_at(), "month"), "date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND"),
    "tz_": (lambda: D.tz_convert(_at(), "Asia/Tokyo"), "ts + INTERVAL 9 HOUR"), "local_": (lambda: D.tz_localize(_at(), "Asia/Tokyo"), "ts - INTERVAL 9 HOUR"),
    "days_": (lambda: D.days(F.unix_micros(_at()) - 1704067200000000), "(epoch_us(ts) - 1704067200000000) // 86400000000"), "seconds_": (lambda: D.seconds(F.unix_micros(_at()) - 1704067200000000), "((epoch_us(ts) - 1704067200000000) % 86400000000) // 1000000"), "total_": (lambda: D.total_seconds(F.unix_micros(_at()) - 1704067200000000), "(epoch_us(ts) - 1704067200000000) / 1e6"),
})


@plan("SELECT doc_id, length(text)::INT AS n, len(regexp_extract_all(text, '[^\\s]+'))::INT AS words FROM documents")
def string_words(s, d):
    return T(s, d, "documents").select("doc_id", F.length("text").alias("n"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("words"))
