"""Token windows over a transcript: greedy packing of whole segments with a restart some segments back.

From each segment the window that starts there is fixed by prefix sums of token costs: a range window finds, per segment,
the first one that doesn't fit, and the next window starts some segments before that one. The windows are the chain of
these edges from segment 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, stripped
from ..plans.stages import staged
from . import chains

PREFIX_TOKENS = 8


def token_windows(segments: DataFrame, target_tokens: int = 1800, overlap: int = 2, block: int = chains.BLOCK) -> DataFrame:
    """(transcript_id, window, first_idx, last_idx, start_ms, end_ms) over segments with text, numbered anew."""
    s = segments.filter(stripped(F.col("text")) != "")
    order = Window.partitionBy("transcript_id").orderBy("seg_idx")
    s = s.select("transcript_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "start_ms", "end_ms", (estimate_tokens(F.col("text")) + PREFIX_TOKENS).alias("cost"))
    s = s.withColumn("base", F.sum("cost").over(Window.partitionBy("transcript_id").orderBy("idx")) - F.col("cost"))
    # The segments whose costs before them are at most the target more than those before this one: all but the last of
    # them fit into a window that starts here, and if nothing follows the last, it may fit as well.
    reach = Window.partitionBy("transcript_id").orderBy("base").rangeBetween(0, target_tokens)
    whole = Window.partitionBy("transcript_id")
    s = s.withColumn("far", F.max("idx").over(reach)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("cost").over(whole))
    stop = F.greatest(F.col("far"), F.col("idx") + 1)
    s = s.withColumn("stop", F.when((F.col("total") - F.col("base") > target_tokens) & (stop < F.col("n")), stop))
    s = staged(s.select("transcript_id", "idx", "start_ms", "end_ms", "stop", "n"), "window-edges")
    edges = s.select(F.col("transcript_id").alias("key"), "idx", F.greatest(F.col("idx") + 1, F.col("stop") - overlap).alias("next"), "stop")
    edges = edges.withColumn("next", F.when(F.col("stop").isNotNull(), F.col("next"))).drop("stop")
    firsts = chains.follow(edges, block).withColumnRenamed("key", "transcript_id")
    found = firsts.join(s, ["transcript_id", "idx"]).select("transcript_id", F.col("step").alias("window"), F.col("idx").alias("first_idx"), (F.coalesce("stop", "n") - 1).alias("last_idx"), "start_ms")
    return found.join(s.select("transcript_id", F.col("idx").alias("last_idx"), "end_ms"), ["transcript_id", "last_idx"]).select("transcript_id", "window", "first_idx", "last_idx", "start_ms", "end_ms")


def window_text(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """(transcript_id, window, text): a line "[start] text" for each segment of a window that has text."""
    s = segments.filter(stripped(F.col("text")) != "")
    order = Window.partitionBy("transcript_id").orderBy("seg_idx")
    s = s.select("transcript_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.format_string("[%.1f] %s", F.col("start_ms") / 1000, stripped(F.col("text"))).alias("line"))
    # A window names its segments by position, so each position meets one segment.
    each = windows.select("transcript_id", "window", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    met = each.join(s, ["transcript_id", "idx"])
    lines = met.groupBy("transcript_id", "window").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    return lines.select("transcript_id", "window", F.array_join(F.col("l.line"), "\n").alias("text"))
