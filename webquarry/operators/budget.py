"""Token counts of text tables: estimates, heuristics and counts by a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text as X
from webquarry.options import DEFAULT_CONTEXT_LIMIT

#: Bytes of a text whose windows are looked up from one row.
CHUNK = 1024
#: Bytes of a vocabulary that is sent to all tasks.
LARGEST = 64 << 20


def token_columns(df: DataFrame, text: str, limit: int = DEFAULT_CONTEXT_LIMIT) -> DataFrame:
    """Estimate, limit report and budget status of every row; a projection, also on streams."""
    n = X.token_estimate(F.col(text))
    df = df.withColumn("token_count", n)
    status = X.budget_status(F.col("token_count"), limit)
    return df.withColumns({"report": X.limit_report(F.col("token_count"), limit), "budget": status})


def token_count_vocab(df: DataFrame, vocab: DataFrame, key: str, text: str, encoding: str, largest: int = LARGEST) -> DataFrame:
    """Tokens of every text by a vocabulary: ``key, token_count``.

    From left to right, among the known byte strings that start at a position the one of the
    highest rank is taken, one byte if none is known. A vocabulary of up to ``largest`` bytes goes to all tasks as a trie of bytes, and
    each text is walked where it is read, without any shuffle; a larger one stays a table, see ``_by_windows``.
    """
    words = vocab.filter(F.col("encoding") == encoding)
    size = words.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    if size > largest:
        return _by_windows(df, words, key, text)
    known = [(bytes.fromhex(r["bytes"]), r["rank"]) for r in words.select("bytes", "rank").collect()]
    slim = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    found = slim.mapInArrow(_walk(slim.sparkSession.sparkContext.broadcast(known)), f"key {kind}, token_count bigint")
    return found.select(F.col("key").alias(key), "token_count")


def _walk(shared):
    def walk(batches):
        import pyarrow as pa

        # a node is a number; the child of a node by a byte, and the rank of the string that ends at a node
        child, rank = {}, [None]
        for word, of in shared.value:
            node = 0
            for b in word:
                at = node << 8 | b
                node = child.get(at)
                if node is None:
                    node = child[at] = len(rank)
                    rank.append(None)
            rank[node] = of
        for batch in batches:
            counts = []
            for text in batch.column("text").to_pylist():
                data, i, n = text.encode(), 0, 0
                end = len(data)
                while i < end:
                    best, jump, node, j = -1, 1, 0, i
                    while j < end and (node := child.get(node << 8 | data[j])) is not None:
                        j += 1
                        if (of := rank[node]) is not None and of > best:
                            best, jump = of, j - i
                    i, n = i + jump, n + 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64())], names=["key", "token_count"])

    return walk


def _by_windows(df: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """The count by a vocabulary that is too large to be sent to all tasks.

    The different windows of a text are looked up by an equality join; the known ones become a pattern whose alternatives stand by first
    byte and rank, and the walk is one match of that pattern after the other. Only lengths that the vocabulary has are tried.
    """
    sizes = F.coalesce(words.agg(F.sort_array(F.collect_set("n_bytes"))).scalar(), F.array(F.lit(1)))
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    n = F.octet_length("b")
    chunks = df.select(key, data.alias("b"), sizes.alias("sizes")).filter(n > 0).select(
        key, "b", "sizes", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("c")
    ).select(key, "sizes", F.substr("b", F.col("c") * CHUNK + 1, F.lit(CHUNK) + F.array_max("sizes")).alias("b"))
    windows = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(CHUNK))),
        lambda at: F.transform("sizes", lambda size: F.hex(F.substr("b", at, size))))))
    tried = chunks.select(key, F.explode(windows).alias("bytes")).distinct()
    found = tried.join(words.select("bytes", "rank"), "bytes")
    first = F.substring("bytes", 1, 2)
    by_first = found.groupBy(key, first.alias("first")).agg(
        F.expr("listagg(substr(bytes, 3), '|') WITHIN GROUP (ORDER BY rank DESC)").alias("rests"))
    patterns = by_first.groupBy(key).agg(
        F.concat(F.expr("listagg(concat(first, '(?:', rests, '|)'), '|')"), F.lit("|..")).alias("pattern"))
    texts = df.select(key, F.hex(data).alias("h")).join(patterns, key, "left")
    count = F.regexp_count("h", F.coalesce("pattern", F.lit("..")))
    return texts.select(key, count.cast("bigint").alias("token_count"))
