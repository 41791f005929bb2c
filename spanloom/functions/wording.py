"""Clock times, durations, scene words, report cells, rates and path rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
SCENE_NOUNS = {"silence": "silence", "music": "music", "noise": "background noise", "sound": "sound"}
GROUPS = (
    ("hvb/", "telephone calls (HarperValleyBank)"),
    ("ami/ES2002a/headset/", "meeting, headset mix (AMI ES2002a)"),
    ("ami/ES2002a/sdm/", "meeting, far-field microphone (AMI ES2002a)"),
    ("librispeech/", "read speech (LibriSpeech test-other)"),
)
# ----------------------------------------------------------------------------------------------


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _whole(column: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.bround(column).cast("bigint"))


def clock(seconds: Column | str, tenths: bool = True, hours: bool = True) -> Column:
    """m:ss.t, h:mm:ss.t from an hour on (minutes run on with hours=False)."""
    total = _whole(_c(seconds) * 10.0)
    whole, tenth = F.floor(total / 10), total % 10
    h, rest = F.floor(whole / 3600), whole % 3600
    short = F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
    body = F.when(h > 0, F.format_string("%d:%02d:%02d", h, F.floor(rest / 60), rest % 60)).otherwise(short) if hours else short
    return F.concat(body, F.format_string(".%d", tenth)) if tenths else body


def minutes_clock(seconds: Column | str) -> Column:
    return clock(seconds, hours=False)


def cue_time(seconds: Column | str, separator: str) -> Column:
    """HH:MM:SS and milliseconds after `separator` (`,` in SRT, `.` in VTT)."""
    ms = _whole(_c(seconds) * 1000.0)
    parts = (F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", *parts)


def format_seconds(seconds: Column | str) -> Column:
    """45 s, 1 min, 2 min 30 s."""
    whole = _whole(_c(seconds))
    minutes, rest = F.floor(whole / 60), whole % 60
    return (
        F.when(whole < 60, F.format_string("%d s", whole))
        .when(rest > 0, F.format_string("%d min %d s", minutes, rest))
        .otherwise(F.format_string("%d min", minutes))
    )


def _noun(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCENE_NOUNS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("sound"))


def scene_noun(kind: Column | str = "kind", label: Column | str = "label") -> Column:
    kind, label = _c(kind), F.trim(F.coalesce(_c(label), F.lit("")))
    return F.when((kind == "sound") & (label != ""), F.concat(F.lit("sound ("), label, F.lit(")"))).otherwise(_noun(kind))


def scene_phrase(kind: Column | str, label: Column | str, start: Column | str, end: Column | str) -> Column:
    length = format_seconds(_c(end) - _c(start))
    joiner = F.when(_c(kind) == "silence", F.lit(", ")).otherwise(F.lit(", no speech, "))
    return F.concat(scene_noun(kind, label), joiner, length)


def scene_tag(kind: Column | str = "kind", label: Column | str = "label") -> Column:
    kind, label = _c(kind), F.trim(F.coalesce(_c(label), F.lit("")))
    named = F.concat(F.lit("[sound: "), label, F.lit("]"))
    return F.when((kind == "sound") & (label != ""), named).otherwise(F.concat(F.lit("["), _noun(kind), F.lit("]")))


def split_rows(text: Column | str, limit: int = 42) -> Column:
    """Two rows, cut at the space nearest the middle (the first on a tie), when too long."""
    text = _c(text)
    n = F.length(text)
    middle = F.floor(n / 2).cast("int")
    # The last space up to the middle and the first one from there on (0-based, NULL for none).
    back = F.locate(" ", F.reverse(F.substring(text, F.lit(1), middle + 1)))
    before = F.when(back > 0, middle + 1 - back)
    after = F.nullif(F.position(F.lit(" "), text, middle + 1), F.lit(0)) - 1
    cut = F.when(before.isNull() | (after - middle < middle - before), after).otherwise(before)
    halves = F.concat(F.rtrim(F.substring(text, F.lit(1), cut)), F.lit("\n"), F.ltrim(F.substring(text, cut + 2, n)))
    return F.when((n > limit) & F.contains(text, F.lit(" ")), halves).otherwise(text)


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))


def reviewed_note(text: Column, nothing: Column, open_: Column, marked: str = "as the listener's") -> Column:
    """One sentence on an applied review, NULL when nothing was checked."""
    checked = text + nothing
    first = F.format_string("Reviewed by a listener: %d %s checked", checked, plural(checked, "span", "spans"))
    typed = F.format_string("%d %s words typed after listening, marked " + marked, text, plural(text, "carries", "carry"))
    left = F.format_string("%d still open", open_)
    parts = F.concat_ws("; ", first, F.when(text > 0, typed), F.when(open_ > 0, left))
    return F.when(checked > 0, F.concat(parts, F.lit(".")))


def all_checked(text: Column, nothing: Column, open_: Column) -> Column:
    return F.coalesce((text + nothing > 0) & (open_ == 0), F.lit(False))


def percent(value: Column | str, digits: int = 1) -> Column:
    return F.when(_c(value).isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", 100.0 * _c(value)))


def number(value: Column | str, digits: int = 1) -> Column:
    return F.when(_c(value).isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", _c(value).cast("double")))


def group_of(item: Column | str, groups: tuple[tuple[str, str], ...] = GROUPS) -> Column:
    found = F.lit(None).cast("string")
    for prefix, title in reversed(groups):
        found = F.when(F.startswith(_c(item), F.lit(prefix)), F.lit(title)).otherwise(found)
    return F.coalesce(found, F.lit("other"))


def safe_name(item: Column | str) -> Column:
    return F.replace(_c(item), F.lit("/"), F.lit("__"))


# ---- load and speed ---------------------------------------------------------------------------
def other_load(before: str, after: str) -> Column:
    """Cores other processes kept busy between two snapshots (wall_s, total_cpu_s, self_cpu_s)."""
    def delta(field: str) -> Column:
        return F.col(f"{after}.{field}") - F.col(f"{before}.{field}")

    load = F.greatest(F.lit(0.0), (delta("total_cpu_s") - delta("self_cpu_s")) / delta("wall_s"))
    return F.when(delta("wall_s") > 0, load)


def busy(load: Column, threshold: float = 0.5) -> Column:
    return load > threshold


def real_time_factor(transcribe_s: Column, audio_s: Column) -> Column:
    return F.when(audio_s > 0, transcribe_s / audio_s)


# ---- paths -------------------------------------------------------------------------------------
def canonical_path(path: Column | str) -> Column:
    """`path` with single slashes, no `.` steps and every `a/..` pair resolved."""
    path = _c(path)
    absolute = F.startswith(path, F.lit("/"))
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def walk(done: Column, step: Column) -> Column:
        can_drop = (F.size(done) > 0) & (F.element_at(F.concat(done, F.array(F.lit("x"))), F.greatest(F.size(done), F.lit(1))) != "..")
        up = F.when(can_drop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.concat(done, F.array(step)))
        return F.when(step == "..", up).otherwise(F.concat(done, F.array(step)))

    joined = F.array_join(F.aggregate(steps, empty, walk), "/")
    relative = F.when(joined == "", F.lit(".")).otherwise(joined)
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(relative)


def last_parts(path: Column | str, count: Column) -> Column:
    parts = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))
    n = F.least(count, F.size(parts))
    return F.slice(parts, F.size(parts) - n + 1, n)


def general(x: Column | str) -> Column:
    """A number of [0.0001, 1000000) in six significant digits without trailing zeros; halves of
    the last digit, by the number's shortest decimal text, go away from zero."""
    x = _c(x)
    text = F.format_string("%.0f", x)
    for place in range(5, -5, -1):
        text = F.when(F.abs(x) < 10.0**place, F.format_string(f"%.{6 - place}f", x)).otherwise(text)
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def same_recording(recorded: Column | str, source: Column | str) -> Column:
    """Equal when both are absolute and canonically the same, else equal in their last two parts."""
    a, b = _c(recorded), _c(source)
    both = F.startswith(a, F.lit("/")) & F.startswith(b, F.lit("/"))
    size = lambda p: F.size(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")))
    tail = F.least(F.lit(2), size(a), size(b))
    return F.when(both, canonical_path(a) == canonical_path(b)).otherwise(last_parts(a, tail) == last_parts(b, tail))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(name), r".(\.[^.]+)$", 1))


def sibling(path: Column | str, suffix: str, new: str) -> Column:
    """The sibling of `path` that ends in `new` instead of `suffix`."""
    path = _c(path)
    cut = F.substring(path, F.lit(1), F.length(path) - len(suffix))
    return F.when(F.endswith(path, F.lit(suffix)), F.concat(cut, F.lit(new))).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(new)))


def beside(path: Column | str, name: Column | str) -> Column:
    """`name` as it is when absolute, else resolved in the folder of `path`."""
    name = _c(name)
    folder = F.regexp_extract(_c(path), r"^(.*/)?[^/]*$", 1)
    return F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(folder, name))
