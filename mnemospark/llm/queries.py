"""Queries on the problems' tables, by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import spread_row_number
from ..session import cut, load
from .conversations import judge_conversations, message_rows, rebuild_conversations
from .leakage import find_leaks
from .mixing import allocate, mix_report, mix_sources, sized_documents, token_count
from .packing import CAPACITY, pack_sessions, place_pieces
from .personal import personal_spans, replace_personal
from .similar import VectorIndex
from .spans import SharedSpans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to leave out."""
    status = judge_conversations(load(spark, d, "messages"), adopt=False)
    return status.filter("given AND reason IS NOT NULL").select("conversation_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the conversations that are whole."""
    return rebuild_conversations(load(spark, d, "messages"), adopt=False)


def linked_messages(messages: DataFrame) -> DataFrame:
    """The messages with no conversation, each naming the one before it in its conversation as what it replies to."""
    rows = message_rows(messages, content=True).filter("conversation_id IS NOT NULL")
    rows = spread_row_number(rows, ["conversation_id"], [F.col("at"), F.col("id")], "n")
    before = rows.select("conversation_id", (F.col("n") + 1).alias("n"), F.col("id").alias("before"))
    rows = rows.join(before, ["conversation_id", "n"], "left")
    return rows.select("id", F.lit(None).cast("string").alias("conversation_id"), "role", "content", F.to_json(F.struct(F.col("before").alias("reply_to"))).alias("metadata"), F.col("at").alias("created_at"))


def p1_linked(spark: SparkSession, d: str) -> DataFrame:
    """Conversations found over reply links alone: the rows name no conversation, only what they reply to."""
    status = judge_conversations(linked_messages(load(spark, d, "messages")))
    return status.select("conversation_id", "turns", F.col("reason").isNotNull().alias("broken"))


_PERSONAL = (("messages", "content"), ("context_entries", "content_preview"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal data in messages and previews."""
    out = None
    for table, column in _PERSONAL:
        found = personal_spans(load(spark, d, table), F.col("id"), F.col(column)).select(F.lit(table).alias("source_table"), "id", "kind")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def p2_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Messages and previews with placeholders."""
    out = None
    for table, column in _PERSONAL:
        new = replace_personal(load(spark, d, table), F.col("id"), F.col(column)).withColumn("source_table", F.lit(table))
        out = new if out is None else out.unionByName(new)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one collection with a cosine of at least 0.97."""
    index = VectorIndex(load(spark, d, "adb_vectors"), load(spark, d, "adb_collections"), cosine=0.97)
    return index.pairs().select("collection_id", "id_a", "id_b").distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every embedding whose id is divisible by 100, out of all."""
    e = load(spark, d, "embeddings").select(F.lit("e").alias("collection_id"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit(0).alias("updated_at"), F.lit(0).alias("created_at"), "vec_id")
    dims = e.agg(F.max(F.size("vector")).alias("dim")).select(F.lit("e").alias("id"), "dim")
    index = VectorIndex(e, dims, cosine=0.97)
    found = index.nearest(e.filter("vec_id % 100 = 0"), 10)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest within its collection of every usable stored vector whose xxhash64(collection_id, id) is divisible by 100."""
    vectors = load(spark, d, "adb_vectors")
    index = VectorIndex(vectors, load(spark, d, "adb_collections"), cosine=0.97)
    found = index.nearest(vectors.filter(F.xxhash64("collection_id", "id") % 100 == 0), 10)
    return found.select("collection_id", "query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that fill their windows with no token left over."""
    packed = pack_sessions(load(spark, d, "context_entries"))
    return packed.filter("oversize = 0 AND windows > 0 AND free = 0 AND session_id IS NOT NULL").select("session_id")


def p5_open(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sessions: all, those whose total is a multiple of a window, those uncertified, and those of both kinds."""
    packed = pack_sessions(load(spark, d, "context_entries"))
    multiple, unsure = F.col("tokens") % CAPACITY == 0, ~F.col("certified")
    return packed.agg(F.count("*").alias("sessions"), F.count_if(multiple).alias("multiples"), F.count_if(unsure).alias("uncertified"), F.count_if(multiple & unsure).alias("uncertified_multiples"))


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of every entry, or the windows of each of its pieces."""
    return place_pieces(load(spark, d, "context_entries"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that they hold a passage of."""
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """How much of each item the tiles of each document cover, and whether the item leaked by that."""
    leaks = find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return leaks.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("coverage").alias("coverage"), F.max("leaked").alias("leaked"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Target sources that can't reach their share."""
    plan = allocate(sized_documents(load(spark, d, "documents")), load(spark, d, "mix_targets"))
    return plan.filter("short").select("source").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the mix really reaches."""
    sized = sized_documents(load(spark, d, "documents"))
    plan = allocate(sized, load(spark, d, "mix_targets"))
    return mix_report(plan, mix_sources(sized, plan))


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mix that was drawn keeps to its bounds: repeats, and size to 2 % of what is wanted and one largest document."""
    sized = sized_documents(load(spark, d, "documents"))
    plan = allocate(sized, load(spark, d, "mix_targets"))
    got = mix_sources(sized, plan).groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("got"), F.max("repeats").alias("most"))
    largest = sized.groupBy("source").agg(F.max("size").alias("largest"))
    rows = plan.join(got, "source", "left").join(largest, "source", "left").na.fill(0, ["got", "most", "largest"])
    want = F.when(F.col("short"), F.col("size") * F.col("max_repeats")).otherwise(F.col("want"))
    return rows.select("source", "short", (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("got") - want) <= 0.02 * want + F.col("largest")).alias("size_kept"))


#: A public tokenizer's file, at the same path on all machines.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p9_mix(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mix itself, documents sized in tokens of a public tokenizer: (doc_id, source, size, repeats)."""
    documents = load(spark, d, "documents").select("doc_id", "source", "text")
    sized = cut(sized_documents(token_count(documents, tokenizer), F.col("size")))
    return mix_sources(sized, allocate(sized, load(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share at least 400 successive characters."""
    return SharedSpans(load(spark, d, "documents").select("doc_id", "text"), 400).pairs()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Part of each text that is shared elsewhere."""
    return SharedSpans(load(spark, d, "documents").select("doc_id", "text"), 400).report()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_turns, p1_linked, p2_found, p2_replaced, p3_found, p3_nearest, p3_top, p5_found, p5_open, p5_windows, p8_found, p8_covered, p9_found, p9_shares, p9_bounds, p9_mix, p10_found, p10_shares)
}
