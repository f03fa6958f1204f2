"""Captions: words packed into lines, one event a word, subtitle documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import caption_escape, caption_time, stripped
from ..plans.stages import staged
from . import chains


@dataclass(frozen=True)
class Style:
    """Limits of a line, and the look of the subtitle track."""

    max_chars: int = 28
    max_words: int = 6
    max_line_ms: int = 3_000
    hold_ms: int = 350
    scale_percent: int = 112
    # Colours (alpha, blue, green, red), font and layout of the track.
    primary: str = "&H00FFFFFF"
    highlight: str = "&H0000D7FF"
    outline: str = "&H00000000"
    back: str = "&H00000000"
    font: str = "Helvetica"
    size: int = 64
    outline_width: float = 3.0
    shadow: float = 0.0
    bold: int = 1
    alignment: int = 2
    margin_v: int = 180
    margin_h: int = 80


def caption_lines(words: DataFrame, style: Style = Style(), block: int = chains.BLOCK) -> DataFrame:
    """words (clip_id, w, text, start_ms, end_ms) with `line`: a new line starts when a word would pass the characters,
    the words or the time of one. Blank words go.

    From each word the line that starts there ends within max_words words, so its neighbours tell where the next line
    starts; the lines are the chain of these edges from the first word."""
    w = words.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    order = Window.partitionBy("clip_id").orderBy("w")
    w = w.withColumn("_idx", (F.row_number().over(order) - 1).cast("long"))
    chars = F.sum(F.length("text") + 1).over(order)  # those of a line of words p to c: chars(c) - chars(p - 1) - 1
    sized = w.withColumn("_chars", chars)
    before = F.col("_chars") - F.length("text") - 1
    full = lambda k: (F.lead("_chars", k).over(order) - before - 1 > style.max_chars) | (F.lead("end_ms", k).over(order) - F.col("start_ms") > style.max_line_ms)
    after = F.coalesce(*[F.when(full(k), F.col("_idx") + k) for k in range(1, style.max_words)], F.when(F.lead("_idx", style.max_words).over(order).isNotNull(), F.col("_idx") + style.max_words))
    edges = staged(sized.withColumn("_next", after).drop("_chars"), "caption-edges")
    firsts = chains.follow(edges.select(F.col("clip_id").alias("key"), F.col("_idx").alias("idx"), F.col("_next").alias("next")), block)
    marked = edges.join(firsts.select(F.col("key").alias("clip_id"), F.col("idx").alias("_idx"), "step"), ["clip_id", "_idx"], "left")
    by_place = Window.partitionBy("clip_id").orderBy("_idx")
    return marked.select(*[marked[c] for c in w.columns if c != "_idx"], F.last("step", True).over(by_place).alias("line"))


def caption_events(lines: DataFrame, offset_ms: int = 0, style: Style = Style()) -> DataFrame:
    """An event for each word of caption_lines(): from its start to the next word's, the last of a line until the hold
    or the next line. Events without length go, and never do two overlap."""
    in_line = Window.partitionBy("clip_id", "line").orderBy("w")
    spans = lines.groupBy("clip_id", "line").agg(F.max_by("end_ms", "w").alias("last_end"), F.min_by("start_ms", "w").alias("first_start"))
    following = F.lead("first_start").over(Window.partitionBy("clip_id").orderBy("line"))
    spans = spans.withColumn("line_end", F.least(F.col("last_end") + style.hold_ms, following)).select("clip_id", "line", "line_end")
    each = lines.join(spans, ["clip_id", "line"]).withColumn("pos", F.row_number().over(in_line) - 1)
    end = F.coalesce(F.lead("start_ms").over(in_line), F.col("line_end")) - offset_ms
    each = each.withColumn("end_at", end).withColumn("start_at", F.greatest(F.lit(0), F.col("start_ms") - offset_ms))
    kept = each.filter((F.col("end_at") > 0) & (F.col("end_at") > F.col("start_at")))
    return kept.select("clip_id", "line", "w", "pos", "text", F.col("start_at").alias("start_ms"), F.col("end_at").alias("end_ms"))


def dialogue(events: DataFrame, lines: DataFrame, style: Style = Style()) -> DataFrame:
    """(clip_id, w, dialogue): each event's subtitle line, the active word marked."""
    texts = lines.groupBy("clip_id", "line").agg(F.array_sort(F.collect_list(F.struct("w", caption_escape(F.col("text")).alias("text")))).alias("ws"))
    opened = f"{{\\c{style.highlight}\\t(0,120,\\fscx{style.scale_percent}\\fscy{style.scale_percent})}}"
    closed = f"{{\\c{style.primary}\\fscx100\\fscy100}}"
    met = events.join(texts, ["clip_id", "line"])
    active = F.col("w")
    marked = F.transform("ws", lambda x: F.when(x["w"] == active, F.concat(F.lit(opened), x["text"], F.lit(closed))).otherwise(x["text"]))
    head = F.concat(F.lit("Dialogue: 0,"), caption_time(F.col("start_ms") / 1000), F.lit(","), caption_time(F.col("end_ms") / 1000), F.lit(",Main,,0,0,0,,"))
    return met.select("clip_id", "w", F.concat(head, F.array_join(marked, " ")).alias("dialogue"))


# The fields of a style and of an event, in a subtitle file's order.
STYLE_FIELDS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
    "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def header(style: Style = Style(), width: int = 1080, height: int = 1920) -> str:
    """What a subtitle file says before its events: the picture's size, the one style, the fields."""
    colours = [style.primary, style.primary, style.outline, style.back]
    values = ["Main", style.font, style.size, *colours, style.bold, 0, 0, 0, 100, 100, 0, 0, 1, style.outline_width, style.shadow, style.alignment, style.margin_h, style.margin_h, style.margin_v, 1]
    info = {"ScriptType": "v4.00+", "PlayResX": width, "PlayResY": height, "WrapStyle": 2, "ScaledBorderAndShadow": "yes"}
    sections = {
        "Script Info": [f"{k}: {v}" for k, v in info.items()],
        "V4+ Styles": [f"Format: {STYLE_FIELDS}", "Style: " + ",".join(map(str, values))],
        "Events": [f"Format: {EVENT_FIELDS}"],
    }
    return "\n\n".join("\n".join([f"[{name}]", *lines]) for name, lines in sections.items()) + "\n"


def documents(dialogues: DataFrame, header: str) -> DataFrame:
    """(clip_id, document): a subtitle document for each clip."""
    per = dialogues.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("w", "dialogue"))).alias("d"))
    return per.select("clip_id", F.concat(F.lit(header), F.array_join(F.col("d.dialogue"), "\n"), F.lit("\n")).alias("document"))
