"""The registered queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm import contamination, lines, merkle, mixing, oracles, packing, periodic, quality, recompression, secrets, setjoin, simhash, sketches, tokenfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op11_jaccard_join": oracles.JACCARD, "op13_merkle_manifest": oracles.MERKLE}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5


@register
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").filter(fold() != 0)
    weights, _ = quality.fit(docs.select("doc_id", "text"), quality.good_ids(known))
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@register
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the span of every benchmark item that a document contains."""
    return contamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and its parts with their shards and places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "parts")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written."""
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = recompression.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    found = packing.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, with their likeness."""
    return sketches.compared(table(spark, sf_dir, "documents"))


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("guess"))


@register
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text of every document."""
    found = lines.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return setjoin.joined(table(spark, sf_dir, "documents"))


def planted(doc_id: str = "doc_id", text: str = "text"):
    """The text in which, for a tenth of the ids, the words from a place on repeat."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(F.col(text), F.lit(f"({mixing.WORD})"), 1)
    # One element, so that its words are found once.
    again = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit(""))), 0)
    return F.when(h % 10 == 0, again).otherwise(F.col(text))


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent and the digests of runs and text of every document."""
    found = periodic.collapse(table(spark, sf_dir, "documents").select("doc_id", planted().alias("text")))
    # Different quotients of two numbers below 2^25 are different doubles; equal ones are equal.
    rank = F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("e"), r["start"], r["period"], r["length"]))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("top", F.array_min(rank))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


@register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", merkle.leaf([F.col(c) for c in LEAF]).alias("leaf"),
                       F.when(chosen, merkle.leaf([F.col(c) if c != "text" else lowered for c in LEAF])).alias("tampered"))
    found = merkle.manifest(rows, keep=["doc_id", "tampered"])
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    segments = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(segments, 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
