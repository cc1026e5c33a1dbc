"""Queries on scans, cleaning, imputation, labels, encodings and payload checks."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featurelake.catalog.bindings import (ENTITIES, ENTITY_YEARS, WIDE, YEARS, Catalog, entities, entity_years, table,
                                          wide)
from featurelake.functions.scalars import to_number
from featurelake.operators import features as feats
from featurelake.operators import prepare as prep
from featurelake.operators.validate import validate_payload
from featurelake.session import scratch_path
from featurelake.sources.delimited import read_delimited

catalog = Catalog()
WIDE_INDEXES = ["SPEND", "NORD"]
NUMERIC = ["acctbal", "spend", "n_orders"]
CATEGORICAL = ["segment", "nation"]


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 4) for c in columns})


# -- scan and slices -------------------------------------------------------------------------------


@catalog.add("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("sep", ";").option("header", True).csv(path)
    return read_delimited(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                                       "c_mktsegment string")


@catalog.add("year_slice", f"""
WITH wide AS ({WIDE})
SELECT customer_id, NOME, SPEND_1999 AS SPEND, NORD_1999 AS NORD, TIER_1999 AS TIER FROM wide""")
def _(spark, sf):
    return prep.year_slice(wide(spark, sf), "1999", YEARS)


_WIDE_VALUES = [f"{c}_{y}" for y in YEARS for c in ("SPEND", "NORD", "TIER")]
_WIDE_NUMBERS = [f"{c}_{y}" for y in YEARS for c in ("SPEND", "NORD")]


@catalog.add("clean_rows", f"""
WITH wide AS ({WIDE})
SELECT customer_id, {", ".join(_WIDE_VALUES)} FROM wide
WHERE ({" OR ".join(f"{c} IS NOT NULL" for c in _WIDE_NUMBERS)})
  AND 1 + {" + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _WIDE_VALUES)} >= 5""")
def _(spark, sf):
    return prep.clean_rows(wide(spark, sf), not_evidence=["customer_id"])


@catalog.add("impute_median", f"""
WITH wide AS ({WIDE})
SELECT customer_id, {", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM wide)), 4) AS {c}" for c in _WIDE_NUMBERS)} FROM wide""")
def _(spark, sf):
    filled = prep.impute_median(wide(spark, sf).select("customer_id", *_WIDE_NUMBERS))
    return rounded(filled, *_WIDE_NUMBERS)


@catalog.add("impute_constant", f"""
WITH wide AS ({WIDE})
SELECT customer_id, {", ".join(f"coalesce(TIER_{y}, 'Desconhecido') AS TIER_{y}" for y in YEARS)} FROM wide""")
def _(spark, sf):
    return prep.impute_text(wide(spark, sf).select("customer_id", *[f"TIER_{y}" for y in YEARS]))


@catalog.add("numeric_coerce", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END
                            AS DOUBLE) AS amount
FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", to_number(text).alias("amount"))


# -- year over year --------------------------------------------------------------------------------


def _delta_sql(cur: str, prev: str, name: str) -> str:
    return (f"round(coalesce({cur} - {prev}, 0), 4) AS {name}_delta, "
            f"round(coalesce(({cur} - {prev}) / nullif({prev}, 0), 0), 4) AS {name}_velocity")


_CHANGES = [f"{i}_{k}" for i in WIDE_INDEXES for k in ("delta", "velocity")]


@catalog.add("yoy_delta_wide", f"""
WITH wide AS ({WIDE})
SELECT customer_id, {", ".join(_delta_sql(f"{i}_1999", f"{i}_1998", i) for i in WIDE_INDEXES)} FROM wide""")
def _(spark, sf):
    changed = prep.yoy_wide(wide(spark, sf), "1999", "1998", WIDE_INDEXES)
    return rounded(changed.select("customer_id", *_CHANGES), *_CHANGES)


_YOY_SQL = f"""
WITH ey AS ({ENTITY_YEARS})
SELECT c.customer_id, c.year, c.spend, c.nord, {_delta_sql("c.spend", "p.spend", "spend")},
       {_delta_sql("c.nord", "p.nord", "nord")}
FROM ey c LEFT JOIN ey p ON p.customer_id = c.customer_id AND p.year = c.year - 1"""
_LONG_CHANGES = ["spend_delta", "spend_velocity", "nord_delta", "nord_velocity"]


@catalog.add("yoy_delta_lag", _YOY_SQL)
def _(spark, sf):
    return rounded(prep.yoy_lag(entity_years(spark, sf), "customer_id", "year", ["spend", "nord"]), *_LONG_CHANGES)


@catalog.add("yoy_delta_selfjoin", _YOY_SQL)
def _(spark, sf):
    return rounded(prep.yoy_self_join(entity_years(spark, sf), "customer_id", "year", ["spend", "nord"]),
                   *_LONG_CHANGES)


def _stack_sql(digits: int | None) -> str:
    def change(expr: str, name: str) -> str:
        return f"{expr} AS {name}" if digits is None else f"round({expr}, {digits}) AS {name}"

    parts = []
    for i, y in enumerate(YEARS):
        cols = [f"SPEND_{y} AS SPEND", f"NORD_{y} AS NORD", f"TIER_{y} AS TIER", f"{y} AS YEAR_REF"]
        for c in WIDE_INDEXES:
            if i == 0:
                cols += [f"CAST(NULL AS DOUBLE) AS {c}_delta", f"CAST(NULL AS DOUBLE) AS {c}_velocity"]
            else:
                cur, prev = f"{c}_{y}", f"{c}_{YEARS[i - 1]}"
                cols += [change(f"coalesce({cur} - {prev}, 0)", f"{c}_delta"),
                         change(f"coalesce(({cur} - {prev}) / nullif({prev}, 0), 0)", f"{c}_velocity")]
        parts.append(f"SELECT customer_id, NOME, {', '.join(cols)} FROM wide")
    return " UNION ALL ".join(parts)


@catalog.add("multiyear_stack", f"WITH wide AS ({WIDE}) {_stack_sql(4)}")
def _(spark, sf):
    return rounded(prep.stack_years(wide(spark, sf), YEARS, YEARS, WIDE_INDEXES), *_CHANGES)


# -- preparation -----------------------------------------------------------------------------------


@catalog.add("prepare_year", f"""
WITH wide AS ({WIDE}),
kept AS (SELECT customer_id, SPEND_1999 AS SPEND, NORD_1999 AS NORD, TIER_1999 AS TIER FROM wide
         WHERE 1 + CAST(SPEND_1999 IS NOT NULL AS INTEGER) + CAST(NORD_1999 IS NOT NULL AS INTEGER)
               + CAST(TIER_1999 IS NOT NULL AS INTEGER) >= 2)
SELECT customer_id, round(coalesce(SPEND, (SELECT median(SPEND) FROM kept)), 4) AS SPEND,
       round(coalesce(NORD, (SELECT median(NORD) FROM kept)), 4) AS NORD, coalesce(TIER, 'Desconhecido') AS TIER
FROM kept""")
def _(spark, sf):
    return rounded(prep.prepare_year(wide(spark, sf), "1999", YEARS), "SPEND", "NORD")


_PREPARED = ["SPEND", "NORD", *_CHANGES]


@catalog.add("prepare_multiyear", f"""
WITH wide AS ({WIDE}), stacked AS ({_stack_sql(None)}),
kept AS (SELECT * FROM stacked WHERE 2 + {" + ".join(
    f"CAST({c} IS NOT NULL AS INTEGER)" for c in ["SPEND", "NORD", "TIER", *_CHANGES])} >= 5)
SELECT customer_id, YEAR_REF, coalesce(TIER, 'Desconhecido') AS TIER, {", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM kept)), 4) AS {c}" for c in _PREPARED)} FROM kept""")
def _(spark, sf):
    return rounded(prep.prepare_multiyear(wide(spark, sf), YEARS, YEARS, WIDE_INDEXES), *_PREPARED)


# -- labels ----------------------------------------------------------------------------------------


def _outcomes(spark, sf):
    status = F.col("o_orderstatus")
    flag = F.when(status == "F", " Sim ").when(status == "P", "TRUE").when(F.col("o_totalprice") > 250000, "no")
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("outcome"))


_OUTCOMES = """
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' Sim ' WHEN o_orderstatus = 'P' THEN 'TRUE'
                          WHEN o_totalprice > 250000 THEN 'no' END AS outcome FROM orders"""
_FLAG = "CAST(coalesce(trim(lower(outcome)) IN ('sim', 'yes', '1', 'true'), false) AS INTEGER)"


@catalog.add("label_from_outcome", f"WITH t AS ({_OUTCOMES}) SELECT o_orderkey, outcome, {_FLAG} AS label FROM t")
def _(spark, sf):
    return feats.label_from_outcome(_outcomes(spark, sf), "outcome", "label")


@catalog.add("label_from_rules", """
SELECT o_orderkey, CAST(coalesce(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'none'
                                              ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) >= 300000, false)
                        OR o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS label
FROM orders""")
def _(spark, sf):
    score = F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", score.alias("score"), F.col("o_orderpriority").alias("tier"))
    labelled = feats.label_from_rules(rows, {"score": 300000, "absent": 1.0}, {"tier": ["1-URGENT", "2-HIGH"]}, "label")
    return labelled.select("o_orderkey", "label")


@catalog.add("target_summary", f"""
WITH t AS ({_OUTCOMES})
SELECT count(*) AS total, CAST(sum({_FLAG}) AS BIGINT) AS positives,
       round(CAST(sum({_FLAG}) AS DOUBLE) * 100 / count(*), 2) AS positive_pct FROM t""")
def _(spark, sf):
    return feats.label_summary(feats.label_from_outcome(_outcomes(spark, sf), "outcome", "label"), "label")


# -- missing columns, encoding, scaling ------------------------------------------------------------


@catalog.add("missing_columns", f"""
WITH e AS ({ENTITIES}) SELECT customer_id, acctbal, segment, 0.0::DOUBLE AS bonus, 'None' AS tier FROM e""")
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", "acctbal", "segment")
    return feats.add_missing_columns(rows, ["acctbal", "bonus"], ["segment", "tier"])


@catalog.add("scoring_defaults", f"""
WITH e AS ({ENTITIES})
SELECT customer_id, acctbal, spend, 2022 AS YEAR_REF, 0.0::DOUBLE AS spend_delta FROM e""")
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", "acctbal", "spend")
    return feats.scoring_defaults(rows, ["acctbal", "spend", "YEAR_REF", "spend_delta"])


def _codes_sql(column: str, where: str = "true") -> str:
    return (f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT coalesce({column}, 'None') AS v FROM e WHERE {where}))")


def _encoded_sql(where: str = "true") -> str:
    joins = " ".join(f"LEFT JOIN {_codes_sql(c, where)} d{i} ON d{i}.v = coalesce(e.{c}, 'None')"
                     for i, c in enumerate(CATEGORICAL))
    codes = ", ".join(f"CAST(coalesce(d{i}.code, -1) AS INTEGER) AS {c}_encoded" for i, c in enumerate(CATEGORICAL))
    return f"SELECT e.*, {codes} FROM e {joins}"


_ENCODED = ["segment_encoded", "nation_encoded"]


@catalog.add("label_encode", f"""
WITH e AS ({ENTITIES}), enc AS ({_encoded_sql()}) SELECT customer_id, segment_encoded, nation_encoded FROM enc""")
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", *CATEGORICAL)
    return feats.apply_dictionary(rows, feats.fit_dictionary(rows, CATEGORICAL), CATEGORICAL).select(
        "customer_id", *_ENCODED)


@catalog.add("label_encode_unseen", f"""
WITH e AS ({ENTITIES}), enc AS ({_encoded_sql("c_nationkey < 20")})
SELECT customer_id, segment_encoded, nation_encoded, -1 AS tier_encoded FROM enc""")
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", "c_nationkey", *CATEGORICAL)
    fitted = feats.fit_dictionary(rows.where("c_nationkey < 20"), CATEGORICAL)
    return feats.apply_dictionary(rows, fitted, [*CATEGORICAL, "tier"]).select(
        "customer_id", *_ENCODED, "tier_encoded")


def _scaled_sql(where: str = "true") -> str:
    stats = ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in NUMERIC)
    cols = ", ".join(
        f"round((coalesce({c}, 0) - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END), 4) AS {c}_scaled"
        for c in NUMERIC)
    return f"SELECT enc.*, {cols} FROM enc, (SELECT {stats} FROM e WHERE {where})"


_SCALED = [f"{c}_scaled" for c in NUMERIC]


def _scale_query(where: str = "true") -> str:
    return (f"WITH e AS ({ENTITIES}), enc AS (SELECT * FROM e), s AS ({_scaled_sql(where)}) "
            f"SELECT customer_id, {', '.join(_SCALED)} FROM s")


@catalog.add("standard_scale", _scale_query())
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", *NUMERIC)
    return rounded(feats.apply_scaling(rows, feats.fit_scaling(rows, NUMERIC)), *_SCALED).select("customer_id", *_SCALED)


@catalog.add("standard_scale_apply", _scale_query("c_nationkey < 20"))
def _(spark, sf):
    rows = entities(spark, sf).select("customer_id", "c_nationkey", *NUMERIC)
    stored = feats.fit_scaling(rows.where("c_nationkey < 20"), NUMERIC)
    return rounded(feats.apply_scaling(rows, stored), *_SCALED).select("customer_id", *_SCALED)


_TRANSFORM_SQL = f"WITH e AS ({ENTITIES}), enc AS ({_encoded_sql()}), s AS ({_scaled_sql()})"


def _transformed(spark, sf):
    rows = entities(spark, sf)
    return feats.FeatureTransform(numeric=NUMERIC, categorical=CATEGORICAL).fit(rows).transform(rows)


@catalog.add("feature_transform", f"""
{_TRANSFORM_SQL} SELECT customer_id, {", ".join([*_SCALED, *_ENCODED])} FROM s""")
def _(spark, sf):
    return rounded(_transformed(spark, sf), *_SCALED).select("customer_id", *_SCALED, *_ENCODED)


_POSITIONS = [*_SCALED, *_ENCODED]


@catalog.add("feature_matrix", f"""
{_TRANSFORM_SQL} SELECT customer_id, 5 AS width, {", ".join(
    f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_POSITIONS))} FROM s""")
def _(spark, sf):
    x = vector_to_array("features")
    return _transformed(spark, sf).select(
        "customer_id", F.size(x).alias("width"), *[F.round(x[i], 4).alias(f"x{i}") for i in range(len(_POSITIONS))])


# -- payload check ---------------------------------------------------------------------------------


@catalog.add("payload_validate", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
                  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
                  CASE WHEN o_totalprice > 400000 THEN 'many' WHEN o_totalprice > 100000 THEN '3' END AS visits
           FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount' END,
                             CASE WHEN priority IS NULL THEN 'priority' END,
                             CASE WHEN visits IS NOT NULL AND TRY_CAST(visits AS INTEGER) IS NULL THEN 'visits' END,
                             'region') AS errors
FROM p""")
def _(spark, sf):
    price = F.col("o_totalprice")
    payload = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(price.cast("string")).alias("amount"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        F.when(price > 400000, "many").when(price > 100000, "3").alias("visits"))
    fields = [("amount", "double", True), ("priority", "string", True), ("visits", "int", False),
              ("region", "string", True), ("note", "string", False)]
    return validate_payload(payload, fields).select("o_orderkey", F.concat_ws(",", "errors").alias("errors"))
