"""Registry of the tabular engine's queries and of their reference SQL.

Dirty text is made from clean columns, so that the reference SQL can say what the clean
value is. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import categorical, dates, numeric
from lumenframe.operators import additive, leakage, metrics, preprocess, profile, score, split, validate
from lumenframe.operators.additive import AdditiveModel, Term
from lumenframe.sources import grid

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- profiles and roles ---------------------------------------------------------------

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_distinct FROM orders" for c in _ORDERS))
def profile_columns(spark, d):
    return profile.profile_frame(t(spark, d, "orders").select(*_ORDERS))


@query(
    "constant_and_id_screen",
    """SELECT 'c_custkey' AS "column", count(*) > 50 AND count(DISTINCT c_custkey) > 0.95 * count(*) AS id_like FROM customer
    UNION ALL SELECT 'c_name', count(*) > 50 AND count(DISTINCT c_name) > 0.95 * count(*) FROM customer
    UNION ALL SELECT 'c_nationkey', count(*) > 50 AND count(DISTINCT c_nationkey) > 0.95 * count(*) FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*) > 50 AND count(DISTINCT c_mktsegment) > 0.95 * count(*) FROM customer""",
)
def constant_and_id_screen(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = c.count()
    p = profile.profile_frame(c)
    return p.select("column", ((F.lit(rows) > 50) & (F.col("n_distinct") > 0.95 * rows)).alias("id_like"))


@query(
    "column_roles",
    """SELECT * FROM (VALUES ('c_custkey', 'dropped'), ('c_name', 'dropped'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical'))
    AS v("column", role)""",
)
def column_roles(spark, d):
    m = preprocess.TabularPreprocessor().fit(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    rows = [(c, "dropped") for c in m.dropped] + [(c, "numeric") for c in m.numeric] + [(c, "categorical") for c in m.categorical]
    return spark.createDataFrame(rows, "`column` string, role string")


@query("integer_id", "SELECT true AS custkey_is_id, false AS nationkey_is_id, false AS acctbal_is_id")
def integer_id(spark, d):
    c = t(spark, d, "customer")
    found = [profile.is_integer_id(c, n, F.col(n).cast("double")) for n in ("c_custkey", "c_nationkey", "c_acctbal")]
    return spark.createDataFrame([tuple(found)], "custkey_is_id boolean, nationkey_is_id boolean, acctbal_is_id boolean")


@query("numeric_ranges", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, 0::BIGINT AS infinite FROM lineitem")
def numeric_ranges(spark, d):
    x = numeric.parse_number(F.col("l_quantity"), native=True)
    y = numeric.finite(x)
    return t(spark, d, "lineitem").agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_if(F.abs(x) == float("inf")).alias("infinite"))


# --- categories -----------------------------------------------------------------------

_NOISY = "CASE WHEN c_custkey % 7 = 0 THEN '  ' || upper(c_mktsegment) || ' ' WHEN c_custkey % 11 = 0 THEN 'NaN' WHEN c_custkey % 13 = 0 THEN NULL ELSE lower(c_mktsegment) END"


@query(
    "clean_categorical",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN '__missing__' ELSE lower(c_mktsegment) END AS segment FROM customer",
)
def clean_categorical(spark, d):
    return t(spark, d, "customer").select("c_custkey", categorical.clean_category(F.expr(_NOISY)).alias("segment"))


@query("vocabulary_gate", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('automobile', 'building') THEN lower(c_mktsegment) ELSE '__missing__' END AS segment FROM customer")
def vocabulary_gate(spark, d):
    return t(spark, d, "customer").select("c_custkey", categorical.gate(categorical.clean_category(F.col("c_mktsegment")), ["automobile", "building"]).alias("segment"))


@query("vocab_capture", "SELECT lower(p_brand) AS brand FROM part GROUP BY 1")
def vocab_capture(spark, d):
    return t(spark, d, "part").select(categorical.clean_category(F.col("p_brand")).alias("brand")).distinct()


# --- numbers in text ------------------------------------------------------------------


def _lines(spark, d, text, **how) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.parse_number(text, **how), 2).alias("value"))


def _price():
    return F.format_number("l_extendedprice", 2)


_CLEAN = "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS value FROM lineitem"


@query("parse_currency", _CLEAN)
def parse_currency(spark, d):
    return _lines(spark, d, F.concat(F.lit("$"), _price()))


@query("parse_currency_code", _CLEAN)
def parse_currency_code(spark, d):
    return _lines(spark, d, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("USD "), _price())).otherwise(F.concat(_price(), F.lit(" EUR"))))


@query("parse_percent", "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 2) AS value FROM lineitem")
def parse_percent(spark, d):
    return _lines(spark, d, F.concat(F.format_number(F.col("l_discount") * 100, 2), F.lit(" %")))


@query("parse_paren_negative", "SELECT l_orderkey, l_linenumber, -round(l_extendedprice, 2) AS value FROM lineitem")
def parse_paren_negative(spark, d):
    odd = F.col("l_linenumber") % 2 == 1
    return _lines(spark, d, F.when(odd, F.concat(F.lit("("), _price(), F.lit(")"))).otherwise(F.concat(_price(), F.lit("-"))))


@query("parse_eu_decimal", _CLEAN)
def parse_eu_decimal(spark, d):
    return _lines(spark, d, F.concat(F.lit("€"), F.translate(_price(), ",.", ".,")), decimal_comma=True)


@query("suppression_codes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS value FROM lineitem")
def suppression_codes(spark, d):
    codes = F.array(*map(F.lit, (" supp", "NE", "*", "..", "Z ")))
    coded = F.element_at(codes, (F.col("l_linenumber") % 5 + 1).cast("int"))
    return _lines(spark, d, F.when(F.col("l_orderkey") % 5 == 0, coded).otherwise(_price()))


@query("decimal_comma_detect", "SELECT true AS european, false AS american, false AS us_column_european, true AS us_column_american")
def decimal_comma_detect(spark, d):
    us, eu = _price(), F.translate(_price(), ",.", ".,")
    return t(spark, d, "lineitem").agg(
        F.bool_or(numeric.european_evidence(eu)).alias("european"), F.bool_or(numeric.american_evidence(eu)).alias("american"),
        F.bool_or(numeric.european_evidence(us)).alias("us_column_european"), F.bool_or(numeric.american_evidence(us)).alias("us_column_american"),
    )


@query(
    "mostly_numeric_share",
    "SELECT count(*) FILTER (WHERE l_orderkey % 9 <> 0) AS eligible, count(*) FILTER (WHERE l_orderkey % 9 <> 0 AND l_orderkey % 7 <> 0) AS numbers FROM lineitem",
)
def mostly_numeric_share(spark, d):
    text = F.when(F.col("l_orderkey") % 9 == 0, "SUPP").when(F.col("l_orderkey") % 7 == 0, "unknown value").otherwise(_price()).alias("v")
    f = profile.text_facts(t(spark, d, "lineitem").select(text), ["v"], None)["v"]
    return spark.createDataFrame([(f["eligible"], f["number_us"])], "eligible long, numbers long")


@query("leftover_codes", "SELECT 'XX' AS token, count(*) AS n FROM lineitem WHERE l_orderkey % 7 = 0 UNION ALL SELECT 'q', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 = 0")
def leftover_codes(spark, d):
    text = F.when(F.col("l_orderkey") % 7 == 0, " XX").when(F.col("l_orderkey") % 11 == 0, "q").otherwise(_price()).alias("v")
    counts, _ = profile.code_leftovers(t(spark, d, "lineitem").select(text), "v", False, None)
    return spark.createDataFrame(counts, "token string, n long")


# --- dates ----------------------------------------------------------------------------


@query(
    "date_parts",
    """SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, lower(strftime(o_orderdate, '%b')) AS m, lower(strftime(o_orderdate, '%a')) AS dow,
    date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE)::DOUBLE AS days FROM orders""",
)
def date_parts(spark, d):
    o = t(spark, d, "orders")
    start = F.lit(str(o.agg(F.min(F.to_date("o_orderdate"))).first()[0])).cast("date")
    at = F.col("o_orderdate")
    return o.select("o_orderkey", *(dates.part(at, p, start).alias(a) for p, a in (("year", "y"), ("month", "m"), ("day_of_week", "dow"), ("days_since_start", "days"))))


@query("event_hours", "SELECT event_id, hour(ts)::DOUBLE AS h, lower(strftime(ts, '%a')) AS dow FROM events")
def event_hours(spark, d):
    at = F.col("ts").cast("timestamp_ntz")
    return t(spark, d, "events").select("event_id", dates.part(at, "hour", at).alias("h"), dates.part(at, "day_of_week", at).alias("dow"))


_DAY = "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders"


def _parsed(spark, d, pattern, dayfirst=False) -> DataFrame:
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), pattern)
    return t(spark, d, "orders").select("o_orderkey", F.to_date(dates.parse_date(text, dayfirst)).alias("day"))


for _name, _pattern, _first in (
    ("parse_date_iso", "yyyy-MM-dd'T'HH:mm:ss", False),
    ("parse_date_dmy", "dd/MM/yyyy", True),
    ("parse_date_mdy", "MM/dd/yyyy", False),
    ("parse_date_named", "d MMM yyyy", False),
    ("parse_date_month_first", "MMM d, yyyy", False),
):
    query(_name, _DAY)(lambda spark, d, p=_pattern, f=_first: _parsed(spark, d, p, f))


@query("dayfirst_detect", "SELECT bool_or(day(o_orderdate) > 12) AS first_over, bool_or(month(o_orderdate) > 12) AS second_over FROM orders")
def dayfirst_detect(spark, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy")
    return t(spark, d, "orders").agg(F.bool_or(dates.field(text, 1) > 12).alias("first_over"), F.bool_or(dates.field(text, 2) > 12).alias("second_over"))


@query(
    "date_order_issue",
    """SELECT o_orderkey, CASE WHEN day(o_orderdate) <> month(o_orderdate) AND day(o_orderdate) <= 12 THEN 'ambiguous_date_format' END AS plain,
    CASE WHEN day(o_orderdate) > 12 THEN 'date_order_mismatch' END AS as_mdy FROM orders""",
)
def date_order_issue(spark, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy")
    return t(spark, d, "orders").select("o_orderkey", dates.order_issue(text, None).alias("plain"), dates.order_issue(text, "mdy").alias("as_mdy"))


# --- validation and splits ------------------------------------------------------------


@query("validate_target", "SELECT count(*) AS n_rows, count(*) - count(o_orderstatus) AS n_missing, count(DISTINCT o_orderstatus) AS n_classes FROM orders")
def validate_target(spark, d):
    return validate.target_profile(t(spark, d, "orders"), "o_orderstatus")


@query("label_encode", "SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INT AS y FROM lineitem")
def label_encode(spark, d):
    li = t(spark, d, "lineitem")
    classes = validate.class_labels(li, "l_returnflag")
    return validate.encode_labels(li, "l_returnflag", classes).select("l_orderkey", "l_linenumber", "y")


@query("group_contingency", "SELECT user_id::VARCHAR AS g, event_type AS y, count(*) AS n FROM events GROUP BY 1, 2")
def group_contingency(spark, d):
    return split.contingency(t(spark, d, "events"), "user_id", y="event_type")


@query("group_sizes", "SELECT lower(trim(c_mktsegment)) AS g, count(*) AS n FROM customer GROUP BY 1")
def group_sizes(spark, d):
    c = t(spark, d, "customer")
    return c.groupBy(split.group_value(c, "c_mktsegment").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("grouped_holdout")
def grouped_holdout(spark, d):
    rows = t(spark, d, "customer").withColumn("y", (F.col("c_acctbal") > 0).cast("int"))
    got = split.group_holdout(rows, "c_nationkey", 0.2).rows
    return got.groupBy("c_nationkey").agg(F.count_if("is_holdout").alias("held"), F.count(F.lit(1)).alias("n"))


@query(
    "stratified_holdout_counts",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), tt AS (SELECT sum(n) AS total, round_even(sum(n) * 0.2, 0) AS held FROM c),
    q AS (SELECT label, n, floor(held * n / total)::BIGINT AS base, held * n / total - floor(held * n / total) AS rest, held FROM c, tt),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS k, held - sum(base) OVER () AS more FROM q)
    SELECT label, base + CASE WHEN k <= more THEN 1 ELSE 0 END AS held FROM r""",
)
def stratified_holdout_counts(spark, d):
    o = t(spark, d, "orders")
    classes = validate.class_labels(o, "o_orderstatus")
    got = split.random_holdout(validate.encode_labels(o, "o_orderstatus", classes), 0.2, key=F.xxhash64("o_orderkey"))
    return got.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count_if("is_holdout").alias("held"))


# --- leakage --------------------------------------------------------------------------


@query("leakage_category", "SELECT 'segment' AS feature, 1.0::DOUBLE AS score, '{automobile, machinery} -> ''yes''; {building, furniture, household} -> ''no''' AS rule")
def leakage_category(spark, d):
    segment = categorical.clean_category(F.col("c_mktsegment"))
    rows = t(spark, d, "customer").select(segment.alias("segment"), F.col("c_acctbal").alias("balance"), segment.isin("automobile", "machinery").cast("int").alias("y"))
    found = leakage.find_leaks(rows, ["no", "yes"], features=["segment", "balance"], categorical=["segment"])
    for s in found:
        s["rule"] = "; ".join(sorted(s["rule"].split("; ")))
    return spark.createDataFrame([(s["feature"], float(s["score"]), s["rule"]) for s in found], "feature string, score double, rule string")


@query("leakage_numeric", "SELECT 'price' AS feature, 1.0::DOUBLE AS score")
def leakage_numeric(spark, d):
    price = F.col("l_extendedprice")
    rows = t(spark, d, "lineitem").select(price.alias("price"), F.col("l_quantity").alias("size"), (price > 50000).cast("int").alias("y"))
    found = leakage.find_leaks(rows, ["no", "yes"], features=["price", "size"], categorical=[])
    return spark.createDataFrame([(s["feature"], float(s["score"])) for s in found], "feature string, score double")


@query("leakage_histogram", "SELECT 'l_returnflag' AS feature, l_returnflag AS category, (l_quantity > 25)::INT AS y, count(*) AS n FROM lineitem GROUP BY 2, 3")
def leakage_histogram(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("y"))
    return leakage.histograms(rows, ["l_returnflag"], ["l_returnflag"]).select("feature", "category", "y", "n")


@query(
    "balanced_accuracy",
    """SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT l_linestatus, avg(((l_quantity > 25) = (l_linestatus = 'O'))::INT) AS r FROM lineitem GROUP BY 1)""",
)
def balanced_accuracy(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_linestatus") == "O").alias("y"), (F.col("l_quantity") > 25).alias("predicted"))
    return leakage.balanced_accuracy(rows).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


# --- the additive model ---------------------------------------------------------------

#: A fixed model on lineitem: l_quantity in bins, l_returnflag by level, and their pair.
CUTS = [10.0, 20.0, 30.0, 40.0]
BINARY = AdditiveModel(
    classes=["low", "high"],
    intercept=[-0.25],
    cuts={"l_quantity": CUTS},
    coarse={"l_quantity": [25.0]},
    levels={"l_returnflag": ["A", "N", "R"]},
    terms=[
        Term(["l_quantity"], [[0.0, -1.2, -0.6, 0.1, 0.7, 1.3]], 0.8),
        Term(["l_returnflag"], [[0.0, 0.5, -0.4, 0.2]], 0.4),
        Term(["l_quantity", "l_returnflag"], [[[0.0, 0.0, 0.0, 0.0], [0.0, 0.1, -0.1, 0.2], [0.0, -0.2, 0.3, 0.05]]], 0.2),
    ],
    ranges={"l_quantity": [1.0, 50.0]},
)
MULTI = AdditiveModel(
    classes=["a", "b", "c"],
    intercept=[0.1, 0.0, -0.1],
    cuts={"l_quantity": CUTS},
    levels={"l_returnflag": ["A", "N", "R"]},
    terms=[
        Term(["l_quantity"], [[0.0, 1.0, 0.5, 0.0, -0.5, -1.0], [0.0, 0.0, 0.2, 0.4, 0.2, 0.0], [0.0, -1.0, -0.5, 0.0, 0.5, 1.0]], 0.6),
        Term(["l_returnflag"], [[0.0, 0.3, 0.0, -0.3], [0.0, 0.0, 0.1, 0.0], [0.0, -0.3, 0.0, 0.3]], 0.2),
    ],
)
_BIN = "CASE WHEN l_quantity IS NULL THEN 0 ELSE 1 + (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT END"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END"
_BINS = f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, {_BIN} AS qb, {_FLAG} AS fb, CASE WHEN l_quantity IS NULL THEN 0 ELSE 1 + (l_quantity >= 25)::INT END AS pb FROM lineitem"
_TERMS = f"""b AS ({_BINS}),
s AS (SELECT *, ([0.0, -1.2, -0.6, 0.1, 0.7, 1.3]::DOUBLE[])[qb + 1] AS s1, ([0.0, 0.5, -0.4, 0.2]::DOUBLE[])[fb + 1] AS s2,
  ([0, 0, 0, 0, 0, 0.1, -0.1, 0.2, 0, -0.2, 0.3, 0.05]::DOUBLE[])[pb * 4 + fb + 1] AS s3 FROM b),
z AS (SELECT *, -0.25 + s1 + s2 + s3 AS z FROM s),
p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM z)"""


@query("bin_numeric", f"WITH b AS ({_BINS}) SELECT qb AS bin, count(*) AS n FROM b GROUP BY 1")
def bin_numeric(spark, d):
    binned = additive.bin_frame(t(spark, d, "lineitem").select("l_quantity"), BINARY.cuts, {})
    return binned.groupBy(F.col("b_l_quantity").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bin_histogram_gradients",
    f"WITH {_TERMS} SELECT pb AS a, fb AS b, round(sum((l_linestatus = 'O')::INT - p), 6) AS g, round(sum(p * (1 - p)), 6) AS h, count(*) AS n FROM p GROUP BY 1, 2",
)
def bin_histogram_gradients(spark, d):
    rows = score.score(BINARY, t(spark, d, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus"))
    binned = additive.bin_frame(rows, BINARY.coarse, BINARY.levels, "p_")
    p = F.col("probability")[1]
    got = additive.pair_gains(binned, [("l_quantity", "l_returnflag")], [(F.col("l_linestatus") == "O").cast("int") - p], [p * (1 - p)])
    return got.select("a", "b", F.round("g0", 6).alias("g"), F.round("h0", 6).alias("h"), "n")


@query("score_binary", f"WITH {_TERMS} SELECT l_orderkey, l_linenumber, round(z, 9) AS raw, round(p, 9) AS probability, CASE WHEN p > 0.5 THEN 'high' ELSE 'low' END AS predicted FROM p")
def score_binary(spark, d):
    got = score.score(BINARY, t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("raw")[0], 9).alias("raw"), F.round(F.col("probability")[1], 9).alias("probability"), F.col("predicted_class").alias("predicted"))


_MULTI = f"""b AS ({_BINS}),
z AS (SELECT *, 0.1 + ([0, 1, 0.5, 0, -0.5, -1]::DOUBLE[])[qb + 1] + ([0, 0.3, 0, -0.3]::DOUBLE[])[fb + 1] AS z0,
  ([0, 0, 0.2, 0.4, 0.2, 0]::DOUBLE[])[qb + 1] + ([0, 0, 0.1, 0]::DOUBLE[])[fb + 1] AS z1,
  -0.1 + ([0, -1, -0.5, 0, 0.5, 1]::DOUBLE[])[qb + 1] + ([0, -0.3, 0, 0.3]::DOUBLE[])[fb + 1] AS z2 FROM b),
e AS (SELECT *, exp(z0) + exp(z1) + exp(z2) AS total FROM z)"""


@query("score_multiclass", f"WITH {_MULTI} SELECT l_orderkey, l_linenumber, round(exp(z0) / total, 9) AS p0, round(exp(z1) / total, 9) AS p1, round(exp(z2) / total, 9) AS p2 FROM e")
def score_multiclass(spark, d):
    got = score.score(MULTI, t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))
    return got.select("l_orderkey", "l_linenumber", *(F.round(F.col("probability")[k], 9).alias(f"p{k}") for k in range(3)))


@query(
    "top_contributions",
    f"""WITH {_TERMS} SELECT l_orderkey, l_linenumber, greatest(abs(s1), abs(s2), abs(s3)) AS largest,
    CASE WHEN CASE WHEN abs(s1) >= greatest(abs(s2), abs(s3)) THEN s1 WHEN abs(s2) >= abs(s3) THEN s2 ELSE s3 END > 0 THEN 'high' ELSE 'low' END AS direction FROM p""",
)
def top_contributions(spark, d):
    got = score.explain(BINARY, t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), top_n=1)
    top = F.col("contributions")[0]
    return got.select("l_orderkey", "l_linenumber", F.abs(top["score"]).alias("largest"), top["direction"].alias("direction"))


@query("additivity_check", "SELECT count(*) AS n, count(*) AS verified FROM lineitem")
def additivity_check(spark, d):
    got = score.explain(BINARY, t(spark, d, "lineitem").select("l_quantity", "l_returnflag"), top_n=1)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if("additivity_verified").alias("verified"))


_CHECKED = preprocess.PreprocessorModel(
    settings=preprocess.Settings(), numeric=["l_quantity"], categorical=["l_returnflag"], vocabulary={"l_returnflag": ["__missing__", "a", "n"]}, ranges={"l_quantity": [5.0, 45.0]}
)


@query(
    "check_inputs",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_orderkey % 6 <> 0 AND l_orderkey % 5 = 0 THEN 'unparseable_number' END,
      CASE WHEN l_orderkey % 6 <> 0 AND l_orderkey % 5 <> 0 AND (l_quantity < 5 OR l_quantity > 45) THEN 'out_of_range' END,
      CASE WHEN l_returnflag = 'R' THEN 'unseen_category' END) AS issues, (l_orderkey % 6 = 0 OR l_orderkey % 5 = 0)::INT AS n_missing FROM lineitem""",
)
def check_inputs(spark, d):
    quantity = F.when(F.col("l_orderkey") % 6 == 0, "").when(F.col("l_orderkey") % 5 == 0, "n/k?").otherwise(F.col("l_quantity").cast("string"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quantity.alias("l_quantity"), "l_returnflag")
    got = _CHECKED.check_inputs(rows)
    return got.select("l_orderkey", "l_linenumber", F.array_join(F.col("input_warnings.issue"), ",").alias("issues"), F.size("missing_features").alias("n_missing"))


@query("preprocess_transform", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'R' THEN '__missing__' ELSE lower(l_returnflag) END AS l_returnflag FROM lineitem")
def preprocess_transform(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return _CHECKED.transform(rows, keep=["l_orderkey", "l_linenumber"])


@query("term_importance", f"WITH {_TERMS} SELECT round(avg(abs(s1)), 6) AS t1, round(avg(abs(s2)), 6) AS t2, round(avg(abs(s3)), 6) AS t3 FROM p")
def term_importance(spark, d):
    got = score.explain(BINARY, t(spark, d, "lineitem").select("l_quantity", "l_returnflag"), top_n=3)
    each = got.select(F.explode("contributions").alias("c")).groupBy(F.col("c.term").alias("term")).agg(F.avg(F.abs("c.score")).alias("a"))
    pick = lambda name: F.round(F.max(F.when(F.col("term") == name, F.col("a"))), 6)
    return each.agg(pick("l_quantity").alias("t1"), pick("l_returnflag").alias("t2"), pick("l_quantity & l_returnflag").alias("t3"))


@query("feature_rollup", "SELECT * FROM (VALUES ('l_quantity', 1.0::DOUBLE, 0.8::DOUBLE, 0.2::DOUBLE), ('l_returnflag', 0.6::DOUBLE, 0.4::DOUBLE, 0.2::DOUBLE)) AS v(feature, total_importance, main_effect, via_interactions)")
def feature_rollup(spark, d):
    from lumenframe.operators.importance import global_importance

    rows = [tuple(float(v) if i else v for i, v in enumerate(r.values())) for r in global_importance(BINARY)["features"]]
    return spark.createDataFrame(rows, "feature string, total_importance double, main_effect double, via_interactions double")


@query("shape_summary", "SELECT * FROM (VALUES ('l_quantity', '[40, 50]', 1.3::DOUBLE, '[1, 10]', -1.2::DOUBLE), ('l_returnflag', 'A', 0.5::DOUBLE, 'N', -0.4::DOUBLE)) AS v(feature, highest, high, lowest, low)")
def shape_summary(spark, d):
    from lumenframe.operators.importance import global_importance

    rows = []
    for term in global_importance(BINARY)["terms"]:
        if "shape" in term:
            s = term["shape"]
            hi, lo = (s[k][0] if isinstance(s[k], list) else s[k] for k in ("highest", "lowest"))
            rows.append((term["term"], hi.get("range", hi.get("category")), hi["score"], lo.get("range", lo.get("category")), lo["score"]))
    return spark.createDataFrame(rows, "feature string, highest string, high double, lowest string, low double")


def _scored(spark, d) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_quantity", "l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return score.score(BINARY, rows)


@query("log_loss", f"WITH {_TERMS} SELECT round(-avg(ln(CASE WHEN l_linestatus = 'O' THEN p ELSE 1 - p END)), 9) AS log_loss FROM p")
def log_loss(spark, d):
    return _scored(spark, d).agg(F.round(metrics.log_loss(F.col("y"), F.col("probability")), 9).alias("log_loss"))


@query("accuracy", f"WITH {_TERMS} SELECT round(avg(((p > 0.5) = (l_linestatus = 'O'))::INT), 9) AS accuracy FROM p")
def accuracy(spark, d):
    return _scored(spark, d).agg(F.round(metrics.accuracy(F.col("y"), F.col("predicted")), 9).alias("accuracy"))


@query(
    "roc_auc",
    f"""WITH {_TERMS}, r AS (SELECT (l_linestatus = 'O')::INT AS y, rank() OVER (ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2.0 AS r FROM p)
    SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9)::DOUBLE AS roc_auc FROM r""",
)
def roc_auc(spark, d):
    auc = metrics.roc_auc(_scored(spark, d), F.round(F.col("probability")[1], 9), F.col("y") == 1)
    return spark.createDataFrame([(round(auc, 9),)], "roc_auc double")


@query("footnote_strip", "SELECT * FROM (VALUES (1), (2), (4)) AS v(row_idx)")
def footnote_strip(spark, d):
    rows = [(1, ["north", "10", "1"]), (2, ["south", "20", "2"]), (3, [None, None, None]), (4, ["Notes here are data", "5", "3"]), (5, [None, None, None]), (6, ["Source: a survey", None, None]), (7, ["a long remark of six words here", None, None])]
    return grid.strip_footnotes(spark.createDataFrame(rows, "row_idx int, cells array<string>"), width=3).select("row_idx")


@query("train_additive_e2e")
def train_additive_e2e(spark, d):
    """A noisy additive target on the whole of lineitem: train, hold out, evaluate."""
    from lumenframe.plans import api

    noise = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) / 1000.0 - 0.5
    signal = 0.05 * (F.col("l_quantity") - 25.5) + F.when(F.col("l_returnflag") == "A", 1).otherwise(0) - 0.33 + 2 * noise
    rows = t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linestatus", (signal > 0).cast("int").alias("target"))
    got = api.train(rows, "target", holdout_fraction=0.2, hyperparams={"outer_bags": 2, "max_rounds": 60, "learning_rate": 0.1, "interactions": 1})
    e = got.metadata["evaluation"]
    return spark.createDataFrame([(float(e["roc_auc"]), float(e["log_loss"]), float(e["baseline_log_loss"]), int(e["holdout_rows"]))], "roc_auc double, log_loss double, baseline_log_loss double, holdout_rows long")
