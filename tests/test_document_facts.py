"""What a run tells of itself: in the document, in its file, in the header of its text."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import wording as wd
from spanloom.operators import documents as dc
from spanloom.operators import edits as ed
from spanloom.sources import files as fl
from test_documents import decide, document, values


def flat(spark, facts):
    """The parts of the fixture's document, assembled again with more facts."""
    docs = document(spark)
    base = docs.select("item_id", "source.name", "source.sha256", "source.bytes", F.col("duration_s").alias("audio_s"), "profile", "produced_utc")
    more = spark.read.schema("item_id long, " + facts[0]).json(spark.sparkContext.parallelize([json.dumps({"item_id": 1} | facts[1])]))
    return dc.build_document(base.join(more, "item_id"), dc.lines_of(docs), dc.marks_of(docs), dc.scenes_of(docs), dc.speakers_of(docs))


FACTS = ", ".join(f"{c} {t}" for c, t in dc.FACTS.items() if c != "overview") + ", overview array<int>, video boolean, output_base string"
FULL = {
    "version": "1.2", "speaker_failure": "no voice found", "overview": [0, 50, 100], "video": True, "output_base": "call-1",
    "engines": {
        "publisher": {"engine": "north", "model": "m1", "preset": "best"}, "detector": {"engine": "south", "model": "", "word_timing": "segment"},
        "diarization": {"engine": "voices", "labels_found": 3, "settings": {"threshold": 0.5, "labels_folded": 1}, "seconds_per_label": {"a": 9.0}},
    },
    "non_speech": {"seconds_by_kind": {"music": 4.0}, "suppressed_publisher_words": 1, "suppressed_detector_words": 3, "tagged": True},
}


def header(docs):
    return [r.value for r in dc.header_rows(docs).orderBy("at").collect()]


def test_all_facts_in_document_file_and_header(spark, tmp_path):
    docs = flat(spark, (FACTS, FULL))
    fl.write_documents(docs, str(tmp_path / "d"))
    back, _ = fl.load_documents(spark, str(tmp_path / "d"))
    for row in (docs.first(), back.first()):
        assert (row.version, row.speaker_failure, row.source.video, row.source.outputs) == ("1.2", "no voice found", True, "call-1")
        assert row.overview.asDict() == {"scale": 100, "peaks": [0, 50, 100]} and row.engines.diarization.settings.threshold == 0.5
        assert row.non_speech.seconds_by_kind == {"music": 4.0} and row.non_speech.suppressed_detector_words == 3
    for frame in (docs, back):
        rows = header(frame)
        assert rows[1].endswith("produced t   |   version 1.2, quality level p")
        assert rows[2:7] == [
            "Published engine: north m1 (best)",
            "Checked against: south; its text is never published; its word times are approximate, so the review list may miss short gaps",
            "Speaker labels: voices, clustering threshold 0.5, 1 small label folded into the nearest voice",
            "Speaker labelling did not complete: no voice found",
            "",
        ]
        aside = next(i for i, r in enumerate(rows) if r.startswith("Set aside"))
        assert rows[aside] == (
            "Set aside: 1 word the published engine wrote inside music or noise was set aside (listed in the run record); "
            "3 words the second engine placed inside silence, music or noise were left out of the review list."
        )
        assert rows[aside - 1].startswith("Without speech: ") and rows[aside + 1].startswith("A transcript is a draft")


@pytest.mark.parametrize("absent", [True, False])
def test_no_facts(spark, absent):
    """Columns that are not there, and columns that are null, read alike."""
    rows = header(document(spark) if absent else flat(spark, (FACTS, {})))
    assert rows[2:5] == ["Published engine: none", "Checked against: none; its text is never published", ""]
    assert rows[1].endswith("|   quality level p") and not any("Set aside" in r or "Speaker label" in r for r in rows)
    if not absent:
        row = flat(spark, (FACTS, {})).first()
        assert row.non_speech.asDict() == {"seconds_by_kind": {}, "suppressed_publisher_words": 0, "suppressed_detector_words": 0, "tagged": False}
        assert row.source.video is False and row.source.outputs == "call" and row.overview.peaks is None


def test_label_lines(spark):
    rows = [
        ("v", (2, 0.7, 5)), ("v", (0, 0.7, 2)), ("v", (None, 1.25, 0)), ("v", (None, None, 3)), (None, None),
    ]
    frame = spark.createDataFrame([((e, 1, s, {}),) for e, s in rows] + [(None,)], f"d {dc.DIARIZATION}")
    assert [r[0] for r in frame.select(dc.label_line(F.col("d"))).collect()] == [
        "Speaker labels: v, speaker count fixed at 2 (a speaker the models cannot separate is then hidden inside another label)",
        "Speaker labels: v, clustering threshold 0.7, 2 small labels folded into the nearest voice",
        "Speaker labels: v, clustering threshold 1.25", "Speaker labels: v", "Speaker labels: ", None,
    ]


def test_general_numbers(spark):
    numbers = [0.0, 0.5, 0.85, 1.0, 2.50, 10.0, 100.125, 0.00012345678, 123456.7, 99999.97, 1 / 3, 0.1 + 0.2, -1.5]
    assert values(spark, numbers, "x double", wd.general("x")) == [f"{x:g}" for x in numbers]


def test_totals_and_time_of_review(spark):
    facts = spark.createDataFrame([(1, "n"), (2, "m")], "item_id long, name string")
    totals = spark.createDataFrame([(1, {"music": 2.0}, 3, 0, True)], "item_id long, seconds_by_kind map<string,double>, suppressed_publisher_words long, suppressed_detector_words long, tagged boolean")
    found = {r.item_id: r.non_speech for r in dc.with_non_speech(facts, totals).collect()}
    assert found[1].suppressed_publisher_words == 3 and found[1].tagged and found[2] is None
    docs = flat(spark, (FACTS, {}))
    chosen = decide(spark, [("nothing", "", None), ("text", "well then", None), ("open", "", None)])
    applied = ed.apply_resolutions(docs, chosen, "2024-05-01T00:00:00Z")
    assert applied.first().review_applied.asDict() == {"text": 1, "nothing": 1, "open": 1, "listener_words": 2, "applied_utc": "2024-05-01T00:00:00Z"}
    stripped = ed.strip_listener(applied)
    assert stripped.first().review_applied is None and [l.text for l in stripped.first().lines] == [l.text for l in docs.first().lines]
    assert applied.schema.simpleString() == docs.schema.simpleString()
