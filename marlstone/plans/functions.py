"""Scalar, collection, lambda, generator and JSON functions by group.

Each query evaluates a group of functions over a table; a pair of expressions
is Spark's and the oracle's spelling, a single one is valid for both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, sql_query


def group(name: str, key: str, source: str, columns: dict[str, str | tuple[str, str]], duck_source: str | None = None) -> None:
    spark = ", ".join(f"{c if isinstance(c, str) else c[0]} AS {k}" for k, c in columns.items())
    duck = ", ".join(f"{c if isinstance(c, str) else c[1]} AS {k}" for k, c in columns.items())
    sql_query(name, f"SELECT {key}, {spark} FROM {source}", f"SELECT {key}, {duck} FROM {duck_source or source}")


# ---- strings ---------------------------------------------------------------

group("fn_string_case", "p_partkey", "part", {
    "a": "upper(p_name)", "b": "lower(p_brand)", "c": ("initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"),
    "d": ("ucase(p_name)", "upper(p_name)"), "e": ("lcase(p_type)", "lower(p_type)"),
})
group("fn_string_length", "p_partkey", "part", {
    "a": "CAST(length(p_name) AS BIGINT)", "b": ("CAST(char_length(p_name) AS BIGINT)", "CAST(length(p_name) AS BIGINT)"),
    "c": ("CAST(character_length(p_name) AS BIGINT)", "CAST(length(p_name) AS BIGINT)"), "d": ("CAST(bit_length(p_name) AS BIGINT)", "CAST(strlen(p_name) * 8 AS BIGINT)"),
    "e": ("CAST(octet_length(p_name) AS BIGINT)", "CAST(strlen(p_name) AS BIGINT)"),
})
group("fn_string_trim", "p_partkey", "(SELECT p_partkey, concat('  ', p_name, ' ') AS s FROM part) x", {
    "a": "trim(s)", "b": "ltrim(s)", "c": "rtrim(s)", "d": ("btrim(s)", "trim(s)"), "e": ("trim(BOTH 'x' FROM concat('xx', s, 'x'))", "trim('xx' || s || 'x', 'x')"),
})
group("fn_string_pad", "p_partkey", "part", {
    "a": "lpad(p_brand, 12, '*')", "b": "rpad(p_brand, 12, '-')", "c": "repeat(p_brand, 2)", "d": ("space(3)", "repeat(' ', 3)"), "e": "reverse(p_name)",
    "f": "left(p_name, 4)", "g": "right(p_name, 4)",
})
group("fn_string_concat", "p_partkey", "(SELECT p_partkey, p_name, nullif(p_brand, 'Brand#2') AS b FROM part) x", {
    "a": ("concat(p_name, '/', b)", "p_name || '/' || b"), "b": "concat_ws('-', p_name, b, 'end')", "c": "p_name || b",
})
group("fn_string_substring", "p_partkey", "part", {
    "a": "substring(p_name, 2, 3)", "b": "substr(p_name, 3)", "c": ("substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]"),
    "d": ("substring_index(p_name, ' ', -1)", "string_split(p_name, ' ')[-1]"), "e": "split_part(p_name, ' ', 2)",
    "f": ("overlay(p_name PLACING 'ZZ' FROM 2 FOR 3)", "substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 5)"),
    "g": ("split(p_name, ' ', -1)[0]", "string_split(p_name, ' ')[1]"),
})
group("fn_string_search", "p_partkey", "part", {
    "a": ("CAST(instr(p_name, 'e') AS BIGINT)", "CAST(instr(p_name, 'e') AS BIGINT)"), "b": ("CAST(locate('e', p_name) AS BIGINT)", "CAST(instr(p_name, 'e') AS BIGINT)"),
    "c": ("CAST(position('e' IN p_name) AS BIGINT)", "CAST(position('e' IN p_name) AS BIGINT)"), "d": "contains(p_name, 'ring')",
    "e": ("startswith(p_name, 'small')", "starts_with(p_name, 'small')"), "f": ("endswith(p_name, 'ring')", "ends_with(p_name, 'ring')"),
    "g": ("CAST(locate('e', p_name, 4) AS BIGINT)", "CAST(CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 3 ELSE 0 END AS BIGINT)"),
})
group("fn_string_replace", "p_partkey", "part", {
    "a": "replace(p_name, 'e', 'EE')", "b": "translate(p_name, 'aeiou', '12345')", "c": ("regexp_replace(p_name, '[aeiou]', '*')", "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    "d": ("regexp_extract(p_brand, '#([0-9]+)', 1)", "regexp_extract(p_brand, '#([0-9]+)', 1)"), "e": ("p_name RLIKE '^(small|red)'", "regexp_matches(p_name, '^(small|red)')"),
    "f": "p_name LIKE '%g'", "g": "p_name ILIKE 'SMALL%'",
})
group("fn_string_code", "p_partkey", "part", {
    "a": ("CAST(ascii(p_name) AS BIGINT)", "CAST(ascii(p_name) AS BIGINT)"), "b": ("chr(65 + p_size % 26)", "chr(CAST(65 + p_size % 26 AS INTEGER))"),
    "c": ("char(97 + p_size % 26)", "chr(CAST(97 + p_size % 26 AS INTEGER))"), "d": ("bin(p_size)", "bin(p_size)"), "e": ("hex(p_name)", "hex(p_name)"),
    "f": ("base64(CAST(p_name AS BINARY))", "base64(encode(p_name))"), "g": ("CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING)", "p_name"),
    "h": ("CAST(unhex(hex(p_name)) AS STRING)", "p_name"), "i": ("decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"),
})
group("fn_string_digest", "p_partkey", "part", {
    "a": "md5(p_name)", "b": "sha1(p_name)", "c": ("sha(p_name)", "sha1(p_name)"), "d": ("sha2(p_name, 256)", "sha256(p_name)"),
    "e": "CAST(levenshtein(p_name, p_type) AS BIGINT)", "f": ("url_encode(p_name)", "replace(url_encode(p_name), '%20', '+')"), "g": ("url_decode(url_encode(p_name))", "p_name"),
})
group("fn_string_format", "p_partkey", "part", {
    "a": ("format_string('%05d-%s', p_size, p_brand)", "printf('%05d-%s', p_size, p_brand)"), "b": ("printf('%d|%s', p_size, p_type)", "printf('%d|%s', p_size, p_type)"),
    "c": ("format_number(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"), "d": ("CAST(to_number('1,234.5', '9,999.9') AS DOUBLE)", "CAST(1234.5 AS DOUBLE)"),
    "e": ("to_char(p_size, '999')", "lpad(CAST(p_size AS VARCHAR), 3, ' ')"),
    "f": ("soundex(p_type)", "CASE p_type WHEN 'ECONOMY' THEN 'E255' WHEN 'PROMO' THEN 'P650' WHEN 'STANDARD' THEN 'S353' WHEN 'SMALL' THEN 'S540' WHEN 'MEDIUM' THEN 'M350' WHEN 'LARGE' THEN 'L620' END"),
})


@query()
def fn_string_engine_specific(t):
    return t.part.select(
        "p_partkey",
        F.expr("luhn_check('79927398713')").alias("luhn"),
        F.sentences("p_name").alias("sentences"),
        F.length(F.expr("uuid()")).alias("uuid_length"),
    )


# ---- math ------------------------------------------------------------------

_P = "(SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) / 60 AS u FROM part) x"
group("fn_math_rounding", "p_partkey", "part", {
    "a": "abs(p_size - 25)", "b": "CAST(ceil(p_retailprice / 7) AS BIGINT)", "c": ("CAST(ceiling(p_retailprice / 7) AS BIGINT)", "CAST(ceil(p_retailprice / 7) AS BIGINT)"),
    "d": "CAST(floor(p_retailprice / 7) AS BIGINT)", "e": "round(p_retailprice / 7, 3)", "f": ("bround(p_size / 2.0D)", "round_even(p_size / 2.0, 0)"),
    "g": ("rint(p_size / 2.0D)", "round_even(p_size / 2.0, 0)"), "h": "CAST(sign(p_size - 25) AS DOUBLE)", "i": ("signum(p_size - 25.0D)", "CAST(sign(p_size - 25) AS DOUBLE)"),
    "j": ("negative(p_size)", "-p_size"), "k": ("positive(p_size)", "p_size"),
})
group("fn_math_powers", "p_partkey", _P, {
    "a": "round(sqrt(p_retailprice), 9)", "b": "round(cbrt(p_retailprice), 9)", "c": "round(exp(u), 9)", "d": "round(pow(u, 3), 9)", "e": "round(power(u, 2), 9)",
    "f": "round(ln(p_retailprice), 9)", "g": "round(log2(p_retailprice), 9)", "h": "round(log10(p_retailprice), 9)", "i": ("round(log(p_retailprice), 9)", "round(ln(p_retailprice), 9)"),
    "j": ("round(expm1(u), 9)", "round(exp(u) - 1, 9)"), "k": ("round(log1p(u), 9)", "round(ln(1 + u), 9)"), "l": ("round(log(2, p_retailprice), 9)", "round(log2(p_retailprice), 9)"),
    "m": ("hypot(3, 4)", "CAST(5 AS DOUBLE)"),
})
group("fn_math_trigonometry", "p_partkey", _P, {
    **{k: f"round({f}(u), 9)" for k, f in zip("abcdefghijkl", "sin cos tan asin acos atan sinh cosh tanh asinh degrees radians".split(), strict=True)},
    "m": "round(atan2(u, 2), 9)", "n": "round(acosh(1 + u), 9)", "o": "round(atanh(u / 2), 9)", "p": "round(cot(u + 0.1), 9)", "q": "round(pi(), 9)",
    "r": ("round(e(), 9)", "round(exp(1), 9)"),
})
group("fn_math_integers", "p_partkey", "part", {
    "a": ("CAST(factorial(p_size % 15) AS BIGINT)", "CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS BIGINT)"), "b": ("pmod(p_size - 30, 7)", "((p_size - 30) % 7 + 7) % 7"),
    "c": ("mod(p_size - 30, 7)", "(p_size - 30) % 7"), "d": "(p_size - 30) % 7", "e": ("CAST(p_partkey DIV 7 AS BIGINT)", "p_partkey // 7"),
    "f": "greatest(p_size, 20, CAST(NULL AS INTEGER))", "g": "least(p_size, 20, CAST(NULL AS INTEGER))",
    "h": ("CAST(width_bucket(p_size, 0, 50, 5) AS BIGINT)", "CAST(p_size // 10 + 1 AS BIGINT)"), "i": ("conv(p_partkey, 10, 16)", "upper(to_hex(p_partkey))"),
})
group("fn_math_bits", "p_partkey", "part", {
    "a": ("CAST(shiftleft(p_partkey, 2) AS BIGINT)", "p_partkey << 2"), "b": ("shiftright(p_partkey, 1)", "p_partkey >> 1"), "c": ("shiftrightunsigned(p_partkey, 1)", "p_partkey >> 1"),
    "d": "CAST(bit_count(p_partkey) AS BIGINT)", "e": ("CAST(bit_get(p_partkey, 1) AS BIGINT)", "(p_partkey >> 1) & 1"), "f": ("CAST(getbit(p_partkey, 0) AS BIGINT)", "p_partkey & 1"),
    "g": "p_partkey & 12", "h": "p_partkey | 3", "i": ("p_partkey ^ 5", "xor(p_partkey, 5)"), "j": "~p_partkey",
})


@query()
def fn_math_engine_specific(t):
    return t.part.select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"), F.rand(3).alias("r"), F.randn(3).alias("g"), F.expr("random(5)").alias("q"))


# ---- dates -----------------------------------------------------------------

_D = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) x"
group("fn_date_parts", "o_orderkey", _D, {
    **{k: f"CAST({f}(d) AS BIGINT)" for k, f in zip("abcdef", "year month day dayofmonth dayofyear quarter".split(), strict=True)},
    "g": "CAST(weekofyear(d) AS BIGINT)", "h": ("CAST(dayofweek(d) AS BIGINT)", "CAST(dayofweek(d) + 1 AS BIGINT)"), "i": ("CAST(weekday(d) AS BIGINT)", "CAST(isodow(d) - 1 AS BIGINT)"),
    "j": "CAST(extract(YEAR FROM d) AS BIGINT)", "k": ("dayname(d)", "substr(dayname(d), 1, 3)"), "l": ("monthname(d)", "substr(monthname(d), 1, 3)"),
})
group("fn_date_time_parts", "event_id", "events", {
    "a": "CAST(hour(ts) AS BIGINT)", "b": "CAST(minute(ts) AS BIGINT)", "c": "CAST(second(ts) AS BIGINT)", "d": "CAST(extract(HOUR FROM ts) AS BIGINT)",
    "e": ("CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)", "date_trunc('hour', ts)"), "f": ("unix_timestamp(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)"),
    "g": ("to_unix_timestamp(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)"),
})
group("fn_date_arithmetic", "o_orderkey", _D, {
    "a": ("date_add(d, 10)", "CAST(d + INTERVAL 10 DAY AS DATE)"), "b": ("date_sub(d, 10)", "CAST(d - INTERVAL 10 DAY AS DATE)"),
    "c": ("CAST(datediff(d, DATE'1995-01-01') AS BIGINT)", "CAST(date_diff('day', DATE '1995-01-01', d) AS BIGINT)"), "d": ("add_months(d, 3)", "CAST(d + INTERVAL 3 MONTH AS DATE)"),
    "e": "last_day(d)", "f": ("trunc(d, 'MM')", "CAST(date_trunc('month', d) AS DATE)"), "g": ("trunc(d, 'YEAR')", "CAST(date_trunc('year', d) AS DATE)"),
    "h": ("next_day(d, 'MON')", "CAST(d + to_days(CAST(8 - isodow(d) AS INTEGER)) AS DATE)"), "i": "make_date(2000, 1, 31)",
    "j": ("CAST(months_between(trunc(d, 'MM'), DATE'1995-01-01') AS BIGINT)", "CAST(date_diff('month', DATE '1995-01-01', d) AS BIGINT)"),
    "k": ("CAST(d + make_ym_interval(1, 2) AS DATE)", "CAST(d + INTERVAL 14 MONTH AS DATE)"),
})
group("fn_date_conversion", "o_orderkey", _D, {
    "a": ("date_format(d, 'yyyy/MM/dd')", "strftime(d, '%Y/%m/%d')"), "b": ("to_date(date_format(d, 'yyyyMMdd'), 'yyyyMMdd')", "d"),
    "c": ("CAST(to_timestamp(concat(date_format(d, 'yyyy-MM-dd'), ' 10:11:12'), 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ)", "CAST(d AS TIMESTAMP) + INTERVAL 36672 SECOND"),
    "d": ("from_unixtime(86400 * 365, 'yyyy-MM-dd')", "'1971-01-01'"), "e": ("CAST(make_timestamp(2020, 2, 29, 1, 2, 3) AS TIMESTAMP_NTZ)", "make_timestamp(2020, 2, 29, 1, 2, 3)"),
    "f": ("to_timestamp_ntz(CAST(d AS STRING))", "CAST(d AS TIMESTAMP)"),
})


@query()
def fn_date_current(t):
    return t.region.select(
        "r_regionkey",
        (F.current_date() == F.curdate()).alias("same_day"),
        (F.now() == F.current_timestamp()).alias("same_time"),
    )


# ---- conditional -----------------------------------------------------------

group("fn_conditional", "c_custkey", "(SELECT c_custkey, nullif(c_nationkey, 3) AS k, c_acctbal FROM customer) x", {
    "a": "coalesce(k, -1)", "b": "nullif(k, 5)", "c": "ifnull(k, 0)", "d": ("nvl(k, 7)", "coalesce(k, 7)"), "e": ("nvl2(k, 'y', 'n')", "CASE WHEN k IS NOT NULL THEN 'y' ELSE 'n' END"),
    "f": ("isnull(k)", "k IS NULL"), "g": ("isnotnull(k)", "k IS NOT NULL"), "h": ("if(k > 10, 'hi', 'lo')", "CASE WHEN k > 10 THEN 'hi' ELSE 'lo' END"),
    "i": "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END", "j": "CASE k WHEN 1 THEN 'one' WHEN 2 THEN 'two' END",
    "k2": ("nanvl(CAST('NaN' AS DOUBLE), c_acctbal)", "c_acctbal"),
})
group("fn_casts", "c_custkey", "customer", {
    "a": "CAST(c_custkey AS VARCHAR(20))", "b": ("CAST(c_acctbal AS INT)", "CAST(trunc(c_acctbal) AS INTEGER)"), "c": ("CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS DOUBLE)", "CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS DOUBLE)"),
    "d": ("try_cast(substring(c_name, 10, 9) AS INT)", "TRY_CAST(substring(c_name, 10, 9) AS INTEGER)"), "e": ("try_cast(c_name AS INT)", "TRY_CAST(c_name AS INTEGER)"),
    "f": ("CAST(c_nationkey AS BOOLEAN)", "CAST(c_nationkey AS BOOLEAN)"), "g": ("7 / 2", "CAST(3.5 AS DOUBLE)"),
})

# ---- arrays and maps -------------------------------------------------------

_AR = "(SELECT p_partkey, split(p_name, '') AS a, split('g,r,e,e,n', ',') AS b, array(p_size, 3, NULL, p_size, 1) AS n FROM part) x"
_AL = "(SELECT p_partkey, string_split(p_name, '') AS a, ['g', 'r', 'e', 'e', 'n'] AS b, [p_size, 3, NULL, p_size, 1] AS n FROM part) x"


def _js(spark: str, duck: str) -> tuple[str, str]:
    """Compare arrays as joined strings; nulls read as a question mark."""
    return f"array_join({spark}, ',', '?')", f"array_to_string(list_transform({duck}, lambda v: coalesce(CAST(v AS VARCHAR), '?')), ',')"


group("fn_array_basic", "p_partkey", _AR, {
    "a1": ("array_contains(a, 'e')", "list_contains(a, 'e')"), "a2": ("CAST(size(n) AS BIGINT)", "CAST(5 AS BIGINT)"), "a3": ("CAST(array_size(n) AS BIGINT)", "CAST(5 AS BIGINT)"),
    "a4": ("CAST(cardinality(n) AS BIGINT)", "CAST(5 AS BIGINT)"), "a5": ("array_max(n)", "list_max(n)"), "a6": ("array_min(n)", "list_min(n)"), "a7": _js("reverse(b)", "list_reverse(b)"),
    "a8": _js("array_distinct(b)", "['g', 'r', 'e', 'n']"), "a9": ("CAST(array_position(b, 'e') AS BIGINT)", "CAST(3 AS BIGINT)"), "b1": _js("array_remove(b, 'e')", "['g', 'r', 'n']"),
    "b2": _js("array_compact(n)", "[p for p in n if p IS NOT NULL]"), "b3": ("element_at(b, -1)", "b[-1]"), "b4": ("element_at(b, 1)", "b[1]"), "b5": ("b[1]", "b[2]"),
    "b6": ("get(b, 9)", "CAST(NULL AS VARCHAR)"), "b7": _js("slice(b, 2, 3)", "b[2:4]"), "b8": _js("slice(b, -2, 2)", "b[4:5]"),
}, _AL)
group("fn_array_sets", "p_partkey", _AR, {
    "a1": _js("sort_array(array_union(a, b))", "list_sort(list_distinct(list_concat(a, b)))"), "a2": _js("sort_array(array_intersect(a, b))", "list_sort(list_distinct(list_intersect(a, b)))"),
    "a3": _js("sort_array(array_except(a, b))", "list_sort(list_distinct([c for c in a if NOT list_contains(b, c)]))"), "a4": ("arrays_overlap(a, b)", "list_has_any(a, b)"),
    "a5": _js("array_append(b, 'z')", "list_append(b, 'z')"), "a6": _js("array_prepend(b, 'z')", "list_prepend('z', b)"), "a7": _js("concat(b, b)", "list_concat(b, b)"),
    "a8": _js("flatten(array(b, b))", "list_concat(b, b)"), "a9": _js("sequence(1, p_partkey % 5 + 1)", "range(1, p_partkey % 5 + 2)"),
    "b1": _js("array_repeat('x', 3)", "['x', 'x', 'x']"), "b2": _js("shuffle(array(1, 1))", "[1, 1]"), "b3": _js("array_insert(b, 2, 'q')", "['g', 'q', 'r', 'e', 'e', 'n']"),
}, _AL)
group("fn_array_sort", "p_partkey", _AR, {
    "a1": _js("sort_array(n)", "list_sort(n, 'ASC', 'NULLS FIRST')"), "a2": _js("sort_array(n, false)", "list_sort(n, 'DESC', 'NULLS LAST')"), "a3": _js("array_sort(n)", "list_sort(n, 'ASC', 'NULLS LAST')"),
    "a4": _js("array_sort(b, (x, y) -> CASE WHEN x > y THEN -1 WHEN x < y THEN 1 ELSE 0 END)", "list_sort(b, 'DESC')"),
    "a5": ("array_join(b, '')", "array_to_string(b, '')"),
}, _AL)
group("fn_array_lambda", "p_partkey", _AR, {
    "a1": _js("transform(n, x -> x * 2)", "list_transform(n, lambda x: x * 2)"), "a2": _js("transform(b, (x, i) -> concat(x, i))", "['g0', 'r1', 'e2', 'e3', 'n4']"),
    "a3": _js("filter(n, x -> x > 2)", "list_filter(n, lambda x: x > 2)"), "a4": ("aggregate(b, '', (acc, x) -> concat(acc, x))", "'green'"),
    "a5": ("aggregate(n, 0L, (acc, x) -> acc + coalesce(x, 0), acc -> acc * 10)", "CAST((2 * n[1] + 4) * 10 AS BIGINT)"),
    "a6": ("exists(n, x -> x > 49)", "CASE WHEN list_bool_or(list_transform(n, lambda x: x > 49)) THEN true END"), "a7": ("forall(b, x -> length(x) = 1)", "true"),
    "a8": ("reduce(b, 0L, (acc, x) -> acc + length(x))", "CAST(5 AS BIGINT)"), "a9": _js("zip_with(b, b, (x, y) -> concat(x, y))", "['gg', 'rr', 'ee', 'ee', 'nn']"),
    "b1": ("arrays_zip(a, b)[0].b", "'g'"),
}, _AL)
_MR = "(SELECT p_partkey, p_size, map('a', p_size, 'b', 2) AS m FROM part) x"
group("fn_map", "p_partkey", _MR, {
    "a1": ("array_join(sort_array(map_keys(m)), ',')", "'a,b'"), "a2": ("array_join(sort_array(map_values(m)), ',')", "array_to_string(list_sort([p_size, 2]), ',')"),
    "a3": ("CAST(size(map_entries(m)) AS BIGINT)", "CAST(2 AS BIGINT)"), "a4": ("element_at(m, 'a')", "p_size"), "a5": ("m['zz']", "CAST(NULL AS INTEGER)"),
    "a6": ("map_contains_key(m, 'b')", "true"), "a7": ("map_concat(m, map('c', 9))['c']", "9"), "a8": ("map_from_arrays(array('x', 'y'), array(1, p_size))['y']", "p_size"),
    "a9": ("map_from_entries(array(struct('k', p_size)))['k']", "p_size"), "b1": ("map_filter(m, (k, v) -> k = 'a')['b']", "CAST(NULL AS INTEGER)"),
    "b2": ("transform_values(m, (k, v) -> v + 1)['a']", "p_size + 1"), "b3": ("transform_keys(m, (k, v) -> upper(k))['B']", "2"), "b4": ("CAST(size(m) AS BIGINT)", "CAST(2 AS BIGINT)"),
    "b5": ("str_to_map('a:1,b:2')['b']", "'2'"), "b6": ("map_zip_with(m, m, (k, x, y) -> x + y)['a']", "p_size * 2"),
}, "part")
group("fn_struct", "p_partkey", "part", {
    "a1": ("named_struct('x', p_size, 'y', p_name).y", "p_name"), "a2": ("struct(p_size, p_name).p_size", "p_size"), "a3": ("to_json(named_struct('x', p_size))", "'{\"x\":' || p_size || '}'"),
    "a4": ("named_struct('a', p_size, 'b', 'x') = named_struct('a', p_size, 'b', 'x')", "true"), "a5": ("to_csv(named_struct('x', p_size, 'y', 'q'))", "p_size || ',q'"),
})


@query("SELECT p_partkey, p_size + 1 AS size, p_name AS name FROM part")
def fn_struct_update(t):
    s = F.struct("p_size", "p_name", "p_type").withField("p_size", F.col("p_size") + 1).dropFields("p_type")
    return t.part.select("p_partkey", s["p_size"].alias("size"), s["p_name"].alias("name"))


# ---- generators ------------------------------------------------------------


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def gen_explode(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') ELSE [NULL] END) AS word FROM part)")
def gen_explode_outer(t):
    return t.part.select("p_partkey", F.explode_outer(F.when(F.col("p_size") > 25, F.split("p_name", " "))).alias("word"))


@query("SELECT p_partkey, i - 1 AS pos, string_split(p_name, ' ')[i] AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def gen_posexplode(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0::BIGINT END AS pos, CASE WHEN p_size > 25 THEN p_brand END AS item FROM part")
def gen_posexplode_outer(t):
    return t.part.select("p_partkey", F.posexplode_outer(F.when(F.col("p_size") > 25, F.array("p_brand"))).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT p_partkey, 'a' AS k, p_size AS v FROM part UNION ALL SELECT p_partkey, 'b', 2 FROM part")
def gen_explode_map(t):
    return t.part.select("p_partkey", F.explode(F.create_map(F.lit("a"), "p_size", F.lit("b"), F.lit(2))).alias("k", "v"))


@query("SELECT p_partkey, p_size AS x, p_name AS y FROM part UNION ALL SELECT p_partkey, 0, 'z' FROM part")
def gen_inline(t):
    rows = F.array(F.struct(F.col("p_size").alias("x"), F.col("p_name").alias("y")), F.struct(F.lit(0).alias("x"), F.lit("z").alias("y")))
    return t.part.select("p_partkey", F.inline(rows))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS x FROM part")
def gen_inline_outer(t):
    return t.part.select("p_partkey", F.inline_outer(F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_size").alias("x"))))))


sql_query(
    "gen_lateral_view",
    "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) x AS w WHERE w LIKE 's%'",
    "SELECT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w LIKE 's%'",
)

# ---- JSON ------------------------------------------------------------------

group("fn_json", "event_id", "events", {
    "a": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"), "b": ("CAST(from_json(props, 'k BIGINT').k AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "c": ("array_join(json_object_keys(props), ',')", "'k'"), "d": ("CAST(json_array_length('[1,2,3]') AS BIGINT)", "CAST(3 AS BIGINT)"),
    "e": ("to_json(from_json(props, 'k BIGINT'))", "'{\"k\":' || json_extract_string(props, '$.k') || '}'"), "f": ("schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"),
})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json_tuple(t):
    return t.events.select("event_id", F.json_tuple("props", "k").alias("k"))


# ---- miscellaneous ---------------------------------------------------------


@query()
def fn_misc_engine_specific(t):
    return t.nation.select(
        "n_nationkey",
        F.hash("n_name").alias("h"),
        F.xxhash64("n_name").alias("x"),
        F.typeof("n_nationkey").alias("kind"),
        F.current_user().alias("who"),
        F.user().alias("user"),
        F.current_database().alias("db"),
        F.current_schema().alias("schema"),
        F.version().alias("version"),
        F.monotonically_increasing_id().alias("mid"),
        F.spark_partition_id().alias("part"),
        F.input_file_name().alias("file"),
        F.assert_true(F.col("n_nationkey") >= 0).alias("ok"),
    )


sql_query("fn_misc_typeof", "SELECT n_nationkey, typeof(n_name) AS a, n_nationkey IS NOT NULL AS b FROM nation", "SELECT n_nationkey, 'string' AS a, true AS b FROM nation")
