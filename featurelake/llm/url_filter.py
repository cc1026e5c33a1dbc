"""Filtering urls by rules, and by a classifier where no rule fits.

``split_url`` cuts host and path. A rule names a host and the beginning of a path; it fits the host and all its
subdomains, and the longest fitting rule decides. All other urls get the verdict of a logistic regression on hashed
character n-grams of host and path, trained from a small labelled url table.

Everything is DataFrame functions and the JVM library of Spark; there is no Python on the executors and no shuffle
except the fit's own sums. The rules are a short list of fixed size (``MAX_RULES``), written into the plan.

The labelled table is a bounded sample of the urls that a rule decides: about ``SAMPLE`` of each verdict, those with the
smallest hashed url, so copies of one url teach at most once.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it, and the method judges
the empty texts. Where no labelled url exists, or all have one verdict, the method gives that verdict, or ``allow``.
Repeated rows each get a row; other columns are left out.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.session import cut_lineage

#: Labelled urls of each verdict to learn from; hashed features of host and of path; length of an n-gram.
SAMPLE, FEATURES, NGRAM = 3000, 1 << 12, 3
MAX_RULES = 1000
ALLOW, BLOCK = "allow", "block"


def split_url() -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of column url."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits columns host and path, and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are written into a plan")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def ngrams(text: str, n: int) -> Column:
    """All character n-grams of a column, with marks at its ends."""
    marked = f"concat('^', {text}, '$')"
    return F.expr(f"transform(sequence(1, greatest(char_length({marked}) - {n - 1}, 1)), i -> substring({marked}, i, {n}))")


def featured(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"host_grams": ngrams("host", NGRAM), "path_grams": ngrams("path", NGRAM)})


def labelled_sample(judged: DataFrame, size: int) -> DataFrame:
    """Distinct urls that a rule decides, about ``size`` of each verdict, evenly by hash."""
    ruled = judged.filter("rule IS NOT NULL").select("host", "path", "decision").distinct()
    share = ruled.groupBy("decision").agg(F.least(F.lit(1.0), size / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) / float(1 << 30)
    return (ruled.join(share, "decision").filter(place < F.col("share"))
            .select("host", "path", (F.col("decision") == BLOCK).cast("double").alias("label")))


def fit(labelled: DataFrame) -> PipelineModel:
    """Logistic regression on the hashed n-grams of host and path of a small table (host, path, label)."""
    stages = [HashingTF(inputCol="host_grams", outputCol="host_hashed", numFeatures=FEATURES, binary=True),
              HashingTF(inputCol="path_grams", outputCol="path_hashed", numFeatures=FEATURES, binary=True),
              VectorAssembler(inputCols=["host_hashed", "path_hashed"], outputCol="features"),
              LogisticRegression(maxIter=30, regParam=1e-3, standardization=False)]
    return Pipeline(stages=stages).fit(featured(labelled))


def judge(pages: DataFrame, rules: list[tuple[str, str]], sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability (null where a rule decides) of every url."""
    host, path = split_url()
    name, decision = rule_columns(rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "decision": decision})
    labelled = cut_lineage(labelled_sample(judged, sample))
    verdicts = [r[0] for r in labelled.select("label").distinct().collect()]  # at most two rows
    if len(verdicts) == 2:
        model = fit(labelled)
        scored = model.transform(featured(judged))
        chance = F.element_at(vector_values("probability"), 2)
    else:
        scored, chance = judged, F.lit(verdicts[0] if verdicts else 0.0)
    open_ = F.col("rule").isNull()
    verdict = F.when(~open_, F.col("decision")).when(chance > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(open_, chance).alias("block_probability"))


def vector_values(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))
