"""Reviewer decisions applied to transcript documents, idempotently.

A decision is (item_id, mark, status, note, speaker): status text, nothing or open; speaker NULL
to infer, '' for none. Documents without a typed decision are handled by expressions alone; a
typed one changes the lines later ones are placed in, so those documents take one ordered pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.cues import LISTENER
from spanloom.operators.documents import LINE, MARK, RESOLUTION, recount
from spanloom.operators.intervals import point_join
from spanloom.operators.labels import line_text
from spanloom.operators.scans import as_of
from spanloom.session import settle

NEAR = 1e-6


def _is_listener(x: Column) -> Column:
    return F.coalesce(x["src"] == LISTENER, F.lit(False))


def _follow_words(line: Column, words: Column) -> Column:
    """The line with these words; text, start and end follow them."""
    return (
        line.withField("words", words)
        .withField("text", line_text(words, "w"))
        .withField("start", F.coalesce(F.array_min(F.transform(words, lambda w: w["s"])), line["start"]))
        .withField("end", F.coalesce(F.array_max(F.transform(words, lambda w: w["e"])), line["end"]))
    )


def strip_listener(docs: DataFrame) -> DataFrame:
    """Documents without reviewer words, lines and decisions; pieces of a split line rejoined."""
    def own(l: Column) -> Column:
        return F.filter(l["words"], lambda w: ~_is_listener(w))

    engine = F.filter("lines", lambda l: ~_is_listener(l) & ((F.size(own(l)) > 0) | (F.size(l["words"]) == 0)))
    clean = F.transform(engine, lambda l: F.when(F.size(own(l)) == F.size(l["words"]), l).otherwise(_follow_words(l, own(l))))

    def join(acc: Column, l: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        words = F.concat(last["words"], l["words"])
        joined = last.withField("words", words).withField("end", l["end"]).withField("text", line_text(words, "w"))
        body = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(last["split_from"] == l["split_from"], F.concat(body, F.array(joined))).otherwise(F.concat(acc, F.array(l)))

    out = docs.withColumn("lines", clean)
    out = out.withColumn("lines", F.aggregate("lines", F.array().cast(f"array<{LINE}>"), join))
    out = out.withColumn("lines", F.transform("lines", lambda l: l.withField("split_from", F.lit(None).cast("int"))))
    bare = F.transform("marks", lambda m: m.withField("resolution", F.lit(None).cast(RESOLUTION)))
    return out.withColumns({"marks": bare, "review_applied": F.lit(None).cast(docs.schema["review_applied"].dataType)})


class _Transcript:
    """The lines of one document while its typed decisions are placed."""

    def __init__(self, lines: list[dict]) -> None:
        self.lines = lines

    def around(self, start: float, end: float) -> dict | None:
        return next((l for l in self.engine() if l["start"] < start - NEAR and l["end"] > end + NEAR), None)

    def engine(self) -> Iterator[dict]:
        return (l for l in self.lines if l["src"] != LISTENER)

    def sides(self, start: float, end: float) -> tuple[dict | None, dict | None]:
        earlier = [l for l in self.engine() if l["end"] <= start + NEAR]
        later = [l for l in self.engine() if l["start"] >= end - NEAR]
        return max(earlier, key=lambda l: l["end"], default=None), min(later, key=lambda l: l["start"], default=None)

    def inferred(self, start: float, end: float) -> str | None:
        holder = self.around(start, end)
        if holder is not None:
            return holder["speaker"]
        sides = self.sides(start, end)
        voices = {side["speaker"] if side else None for side in sides}
        return voices.pop() if len(voices) == 1 else None

    def insert(self, line: dict, words: list[dict]) -> None:
        own = list(line["words"])
        at = next((i for i, w in enumerate(own) if w["s"] >= words[0]["s"] - NEAR), len(own))
        line["words"] = own[:at] + words + own[at:]
        self.follow(line)

    @staticmethod
    def follow(line: dict) -> None:
        line["text"] = _joined(line["words"])
        line["start"] = min(w["s"] for w in line["words"])
        line["end"] = max(w["e"] for w in line["words"])

    def split(self, line: dict, end: float, number: int) -> None:
        before = [w for w in line["words"] if w["s"] < end - NEAR]
        after = [w for w in line["words"] if w["s"] >= end - NEAR]
        if before and after:
            at = next(i for i, l in enumerate(self.lines) if l is line)
            self.lines[at : at + 1] = [
                {**line, "words": part, "start": part[0]["s"], "end": part[-1]["e"], "text": _joined(part), "split_from": number}
                for part in (before, after)
            ]

    def place(self, number: int, start: float, end: float, words: list[dict], chosen: str | None) -> str | None:
        """Put the words where the gap is; returns the speaker they went to."""
        holder = self.around(start, end)
        if holder is not None and (chosen is None or (chosen or None) == holder["speaker"]):
            self.insert(holder, words)
            return holder["speaker"]
        speaker = self.inferred(start, end) if chosen is None else (chosen or None)
        if holder is not None:
            self.split(holder, end, number)
        for side in self.sides(start, end):
            if side is not None and side["speaker"] == speaker:
                self.insert(side, words)
                return speaker
        self.lines.append(
            {"start": start, "end": end, "speaker": speaker, "text": _joined(words), "src": LISTENER, "split_from": None, "words": words}
        )
        return speaker


def _joined(words: list[dict]) -> str:
    return " ".join(t for t in (str(w["w"] or "").strip() for w in words) if t)


def listener_words(note: str, start: float, end: float, number: int) -> list[dict]:
    tokens = note.split()
    step = max(0.0, end - start) / len(tokens) if tokens else 0.0
    return [{"s": start + i * step, "e": start + (i + 1) * step, "w": t, "src": LISTENER, "mark": number} for i, t in enumerate(tokens)]


def _plain(value):
    """Nested values as dicts and lists, whatever Arrow handed over."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and value != value else value


def _typed_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for record in batch.to_dict("records"):
            record = _plain(record)
            doc, marks, words_typed = _Transcript(record["lines"]), record["marks"], 0
            for number, (mark, decision) in enumerate(zip(marks, record["decisions"])):
                note = str(decision["note"] or "").strip()
                if decision["status"] == "text" and note:
                    start, end = mark["span_start"], mark["span_end"]
                    end = end if end > start else start + 0.5
                    words = listener_words(note, start, end, number)
                    speaker = doc.place(number, start, end, words, decision["speaker"])
                    mark["resolution"] = {"status": "text", "note": note, "speaker": speaker or ""}
                    words_typed += len(words)
                elif decision["status"] == "nothing":
                    mark["resolution"] = {"status": "nothing", "note": "", "speaker": None}
            doc.lines.sort(key=lambda l: (l["start"], l["end"]))
            rows.append({"item_id": record["item_id"], "lines": doc.lines, "marks": marks, "listener_words": words_typed})
        yield pd.DataFrame(rows, columns=["item_id", "lines", "marks", "listener_words"])


def decisions_per_item(decisions: DataFrame) -> DataFrame:
    row = F.struct("mark", "status", "note", "speaker")
    return decisions.groupBy("item_id").agg(F.array_sort(F.collect_list(row)).alias("decisions"))


def apply_resolutions(docs: DataFrame, decisions: DataFrame, applied_utc: str | None = None) -> DataFrame:
    """Documents with the decisions applied; an item whose decisions do not match its marks one
    for one is an error. Documents whose record has applied_utc are stamped with the time given."""
    given = strip_listener(docs).join(decisions_per_item(decisions), "item_id", "left")
    none = F.array().cast("array<struct<mark:int,status:string,note:string,speaker:string>>")
    given = given.withColumn("decisions", F.coalesce(F.col("decisions").cast("array<struct<mark:int,status:string,note:string,speaker:string>>"), none))
    wrong = F.raise_error(F.format_string("%d resolutions for %d marks", F.size("decisions"), F.size("marks")))
    given = given.withColumn("decisions", F.when(F.size("decisions") == F.size("marks"), F.col("decisions")).otherwise(wrong.cast(none_type())))
    typed = lambda d: F.coalesce((d["status"] == "text") & (F.trim(d["note"]) != ""), F.lit(False))
    has_text = F.exists("decisions", typed)
    counts = {
        "__text": F.size(F.filter("decisions", typed)),
        "__nothing": F.size(F.filter("decisions", lambda d: F.coalesce(d["status"] == "nothing", F.lit(False)))),
    }
    given = given.withColumns(counts)
    quiet = F.zip_with(
        "marks", "decisions",
        lambda m, d: m.withField("resolution", F.when(d["status"] == "nothing", F.struct(F.lit("nothing").alias("status"), F.lit("").alias("note"), F.lit(None).cast("string").alias("speaker")))),
    )
    ordered = F.array_sort("lines", lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0))
    untyped = given.where(~has_text).withColumns({"marks": quiet, "lines": ordered, "listener_words": F.lit(0)})
    kind = dict(docs.dtypes)["item_id"]
    schema = f"item_id {kind}, lines array<{LINE}>, marks array<{MARK}>, listener_words int"
    passed = given.where(has_text)
    placed = passed.select("item_id", "lines", "marks", "decisions").mapInPandas(_typed_pass, schema)
    written = passed.drop("lines", "marks").join(placed, "item_id")
    both = untyped.unionByName(written)
    opened = F.size("decisions") - F.col("__text") - F.col("__nothing")
    applied = F.struct(F.col("__text").alias("text"), F.col("__nothing").alias("nothing"), opened.alias("open"), F.col("listener_words").alias("listener_words"))
    if applied_utc is not None or "applied_utc" in docs.schema["review_applied"].dataType.fieldNames():
        applied = applied.withField("applied_utc", F.lit(applied_utc).cast("string"))
    return recount(both.withColumn("review_applied", applied)).select(*docs.columns)


def none_type() -> str:
    return "array<struct<mark:int,status:string,note:string,speaker:string>>"


def _before(a: Column, b: Column) -> Column:
    return (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] < b["end"]))


def infer_speakers(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(item_id, mark, speaker): whose voice a gap most plausibly holds, over flat tables: the line
    around the gap, else the speaker of both neighbouring lines, else NULL. `lines` are engine
    lines with (item_id, line, start, end, speaker)."""
    asks = marks.select("item_id", "mark", "span_start", "span_end")
    around = point_join(asks, lines.select("item_id", "line", "start", "end", "speaker"), F.col("span_start"), ("start", "end"))
    inside = around.where((F.col("start") < F.col("span_start") - NEAR) & (F.col("end") > F.col("span_end") + NEAR))
    holder = inside.groupBy("item_id", "mark").agg(F.min(F.struct("line", "speaker"))["speaker"].alias("held"), F.lit(True).alias("is_held"))
    who = F.struct("speaker")
    by_end = lines.groupBy("item_id", "end").agg(F.min(F.struct("line", "speaker"))["speaker"].alias("speaker"))
    by_start = lines.groupBy("item_id", "start").agg(F.min(F.struct("line", "speaker"))["speaker"].alias("speaker"))
    # Read twice by the second of these joins.
    sided = settle(as_of(asks.withColumn("t", F.col("span_start") + NEAR), by_end, ["item_id"], "t", "end", who, "before"))
    sided = as_of(sided.withColumn("t", NEAR - F.col("span_end")), by_start.withColumn("r", -F.col("start")), ["item_id"], "t", "r", who, "after")
    common = F.when(F.col("before.speaker") == F.col("after.speaker"), F.col("before.speaker"))
    joined = sided.join(holder, ["item_id", "mark"], "left")
    return joined.select("item_id", "mark", F.when(F.col("is_held"), F.col("held")).otherwise(common).alias("speaker"))


def valid_sessions(sessions: DataFrame, marks: DataFrame, check_times: bool = False) -> DataFrame:
    """Session entries (item_id, mark, status, note, speaker[, start, end]) of items whose session
    has one entry per mark, and, when asked, at the marks' times within a millisecond; unknown
    statuses count as open. Items whose session does not fit are left out whole."""
    known = F.when(F.col("status").isin("text", "nothing", "open"), F.col("status")).otherwise(F.lit("open"))
    entries = sessions.withColumns({"status": known, "note": F.coalesce("note", F.lit("")), "__s": F.lit(True)})
    wanted = marks.select("item_id", "mark", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.lit(True).alias("__m"))
    both = entries.join(wanted, ["item_id", "mark"], "full_outer")
    fits = F.col("__s").isNotNull() & F.col("__m").isNotNull()
    if check_times:
        close = (F.abs(F.col("start") - F.col("m_start")) <= 1e-3) & (F.abs(F.col("end") - F.col("m_end")) <= 1e-3)
        fits = fits & F.coalesce(close, F.lit(False))
    good = both.groupBy("item_id").agg(F.bool_and(fits).alias("ok")).where("ok")
    return entries.drop("__s").join(good, "item_id", "left_semi")


def fresh_resolutions(marks: DataFrame) -> DataFrame:
    return marks.select("item_id", "mark", F.lit("open").alias("status"), F.lit("").alias("note"), F.lit(None).cast("string").alias("speaker"))


def resolutions_from_document(docs: DataFrame) -> DataFrame:
    """The decisions the documents themselves record, open where there is none."""
    each = docs.select("item_id", F.posexplode("marks").alias("mark", "m"))
    return each.select(
        "item_id", "mark", F.coalesce("m.resolution.status", F.lit("open")).alias("status"), F.coalesce("m.resolution.note", F.lit("")).alias("note"), F.col("m.resolution.speaker").alias("speaker")
    )


def apply_sessions(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Documents revised by their sessions; those without a fitting session keep what they record."""
    from spanloom.operators.documents import marks_of

    entries = settle(valid_sessions(sessions, marks_of(docs)))
    mine = docs.join(entries.select("item_id").distinct(), "item_id", "left_semi")
    return apply_resolutions(mine, entries)


def listener_line_for(docs: DataFrame) -> DataFrame:
    """(item_id, mark, line): the line holding each mark's typed words."""
    words = docs.select("item_id", F.posexplode("lines").alias("line", "l")).select("item_id", "line", F.explode("l.words").alias("w"))
    return words.where(F.col("w.src") == LISTENER).groupBy("item_id", F.col("w.mark").alias("mark")).agg(F.min("line").alias("line"))
