"""Inputs of the registered queries, derived from the given tables, in Spark and in SQL.

Signals are the embeddings; predictions are line items read as scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
# Axis 1800 down in steps of 13.5: every quality band holds points.
AXIS = [1800.0 - 13.5 * i for i in range(WIDTH)]
CLASSES = [1, 3]
FLAGS = ["A", "N", "R"]

# The registered queries, filled by the catalog modules.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    """Rounded to six places, without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- signals ---------------------------------------------------------------------


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """(signal_id, sample_id, group_id, label, y, features); y is the two-class label of every row."""
    label = F.col("label").cast("long")
    group = label * 100 + F.col("vec_id") % 5
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("signal_id"),
        (group * 10 + F.floor(F.col("vec_id") / 5).cast("long") % 2).alias("sample_id"),
        group.alias("group_id"), label.alias("label"),
        F.when(label < 5, F.lit(1)).otherwise(F.lit(3)).cast("long").alias("y"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Signals shifted to look like absorbance, so that the quality limits separate them."""
    return signals(spark, sf).withColumn("features", F.transform("features", lambda v: v * 2.0 + 0.6))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Signals in long form (signal_id, sample_id, pos, value)."""
    return signals(spark, sf).select("signal_id", "sample_id", "group_id", "y", F.posexplode("features").alias("pos", "value")
                                     ).withColumn("pos", F.col("pos").cast("long"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows: each embedding as a position of four 16-point signals."""
    parts = F.array(*[F.slice("features", i * 16 + 1, 16) for i in range(4)])
    return signals(spark, sf).select(
        "signal_id", F.concat(F.lit("D"), F.col("sample_id")).alias("diss_id"),
        F.concat(F.lit("Pos"), F.col("signal_id") % 3).alias("position"), "label", parts.alias("spectra"),
    )


# --- predictions -----------------------------------------------------------------


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Two-class predictions (row ids, group, true, predicted, score of class 3)."""
    score = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("sample_id"),
        F.when(F.col("l_returnflag") == "R", F.lit(3)).otherwise(F.lit(1)).cast("long").alias("y_true"),
        F.when(score >= 0.5, F.lit(3)).otherwise(F.lit(1)).cast("long").alias("y_pred"),
        score.alias("score"), F.array(1.0 - score, score).alias("scores"),
        F.when(F.col("l_linestatus") == "F", F.lit("10200X")).otherwise(F.lit("10220X")).alias("recipe"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("PCA-LDA")).otherwise(F.lit("PLS-DA")).alias("classifier"),
        (F.col("l_orderkey") % 2 + 1).cast("long").alias("repeat"),
        (F.col("l_suppkey") % 3 + 1).cast("long").alias("fold"),
    )


def preds3(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class predictions."""
    scores = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    pick = F.element_at(F.array(*[F.lit(c) for c in FLAGS]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("group_id"), F.col("l_returnflag").alias("y_true"), pick.alias("y_pred"),
        scores.alias("scores"),
        F.col("l_linestatus").alias("config"),
    )


def preds_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("long").alias("y_true"), F.col("toxic").cast("long").alias("y_pred")
    )


# --- metadata --------------------------------------------------------------------


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measured positions: a key, a file name carrying the session, a value."""
    e = table(spark, sf, "events")
    s = F.col("event_id") % 7
    name = F.when(s == 0, F.concat(F.lit("P"), F.col("user_id"), F.lit("_Pos.mat"))).otherwise(
        F.concat(F.lit("P"), F.col("user_id"), F.lit("-S"), s, F.lit("_Pos.mat"))
    )
    return e.select("event_id", F.concat(F.lit(" P"), F.col("user_id"), F.lit(" ")).alias("probe"),
                    F.col("event_type").alias("position"), name.alias("source_file"), "value", "user_id")


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as patients, with raw metadata texts in need of cleaning."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (k % len(vals) + 1).cast("int"))
    return c.select(
        k.alias("custkey"), F.concat(F.lit("  "), k.cast("string"), F.lit(" ")).alias("proben_id"),
        F.concat(F.lit("G"), F.col("c_nationkey")).alias("patient"),
        F.col("c_nationkey").cast("long").alias("nationkey"),
        (F.lit(20.0) + F.col("c_acctbal") / 200.0).alias("age"),
        pick(GRADES).alias("grade_text"), pick(SEXES).alias("sex_text"), pick(SUBTYPE_TEXTS).alias("subtype_text"),
        F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("acctbal"),
    )


GRADES = ["WHO-1 (94)", "who-2", "3", " 1 ", "WHO-3", "n/a", "2.0", "4", ""]
SEXES = ["w", " M ", "Female", "male", "?", ""]
SUBTYPE_TEXTS = ["fibromatös", " meningothelial", "psammomatös ", "NaN", "", "<missing>", "rhabdoid", "klarzellig",
                 "anaplastisch", "Atypisch", "atypisch"]


def split_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as samples of a customer group with a train/test split by hash."""
    o = table(spark, sf, "orders")
    h = F.md5(F.concat(F.lit("split:"), F.col("o_custkey").cast("string")))
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"),
        F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("price"),
        F.when(F.substring(h, 1, 1) < "b", F.lit("train")).otherwise(F.lit("test")).alias("split"),
    )


# --- the same in SQL ---------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_VIEWS = {
    "signals": """SELECT vec_id AS signal_id,
        (CAST(label AS BIGINT)*100 + vec_id%5)*10 + (vec_id//5)%2 AS sample_id,
        CAST(label AS BIGINT)*100 + vec_id%5 AS group_id, CAST(label AS BIGINT) AS label,
        CAST(CASE WHEN label < 5 THEN 1 ELSE 3 END AS BIGINT) AS y,
        CAST(embedding AS DOUBLE[]) AS features FROM embeddings""",
    "spectra": """SELECT signal_id, sample_id, group_id, label, y,
        list_transform(features, lambda v: v*2.0 + 0.6) AS features FROM signals""",
    "axis": "SELECT CAST(i AS BIGINT) AS pos, CAST(1800.0 - 13.5*i AS DOUBLE) AS axis FROM range(0, 64) t(i)",
    "traces": """SELECT signal_id, sample_id, group_id, y, CAST(i AS BIGINT) AS pos, features[i+1] AS value
        FROM signals, range(0, 64) t(i)""",
    "slong": """SELECT signal_id, sample_id, group_id, y, pos, axis, features[pos+1] AS value
        FROM spectra, axis""",
    "positions": """SELECT signal_id, 'D'||sample_id AS diss_id, 'Pos'||(signal_id%3) AS position, label,
        [features[1:16], features[17:32], features[33:48], features[49:64]] AS spectra FROM signals""",
    "preds": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_suppkey AS group_id,
        l_partkey AS sample_id, CAST(CASE WHEN l_returnflag='R' THEN 3 ELSE 1 END AS BIGINT) AS y_true,
        CAST(CASE WHEN l_discount*10 >= 0.5 THEN 3 ELSE 1 END AS BIGINT) AS y_pred, l_discount*10 AS score,
        CASE WHEN l_linestatus='F' THEN '10200X' ELSE '10220X' END AS recipe,
        CASE WHEN l_linenumber%2=0 THEN 'PCA-LDA' ELSE 'PLS-DA' END AS classifier,
        CAST(l_orderkey%2+1 AS BIGINT) AS repeat, CAST(l_suppkey%3+1 AS BIGINT) AS fold FROM lineitem""",
    "preds3": f"""SELECT l_suppkey AS group_id, l_returnflag AS y_true, {_list(FLAGS)}[l_linenumber%3+1] AS y_pred,
        [l_discount*10, l_tax*10, l_quantity/50] AS scores, l_linestatus AS config FROM lineitem""",
    "preds_docs": "SELECT doc_id, CAST(quality AS BIGINT) AS y_true, CAST(toxic AS BIGINT) AS y_pred FROM labels",
    "sessions": """SELECT event_id, ' P'||user_id||' ' AS probe, event_type AS position,
        CASE WHEN event_id%7=0 THEN 'P'||user_id||'_Pos.mat' ELSE 'P'||user_id||'-S'||(event_id%7)||'_Pos.mat' END AS source_file,
        value, user_id FROM events""",
    "subjects": f"""SELECT c_custkey AS custkey, '  '||c_custkey||' ' AS proben_id, 'G'||c_nationkey AS patient,
        CAST(c_nationkey AS BIGINT) AS nationkey, 20.0 + c_acctbal/200.0 AS age,
        {_list(GRADES)}[c_custkey%{len(GRADES)}+1] AS grade_text, {_list(SEXES)}[c_custkey%{len(SEXES)}+1] AS sex_text,
        {_list(SUBTYPE_TEXTS)}[c_custkey%{len(SUBTYPE_TEXTS)}+1] AS subtype_text, c_mktsegment AS cluster,
        c_acctbal AS acctbal FROM customer""",
    "split_orders": """SELECT o_orderkey AS sample_id, o_custkey AS group_id, o_orderstatus AS label, o_totalprice AS price,
        CASE WHEN substr(md5('split:'||o_custkey),1,1) < 'b' THEN 'train' ELSE 'test' END AS split FROM orders""",
}
SQL_NEEDS = {"spectra": ["signals"], "traces": ["signals"], "slong": ["spectra", "axis"], "positions": ["signals"]}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names as ``{signals}`` etc."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in SQL_NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in SQL_VIEWS:
        if "{" + name + "}" in sql:
            add(name)
            sql = sql.replace("{" + name + "}", name)
    if not wanted:
        return sql
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes}, {body[4:].strip()}"
    return f"WITH {ctes} {body}"
