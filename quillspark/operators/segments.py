"""The manual reader as an associative scan, and as a streaming state.

What the reader knows between two lines is small: the headings, whether a
block is open, whether the number of bare markers right before is odd, and how
many blocks were opened. What a run of lines does to it is a function with a
compact form that is closed under composition:

* what lines without headings do is a table over three states (no line in the
  part yet, an even run of bare markers before, an odd one): the state after,
  and the blocks opened;
* a section or subsection sets its heading and begins a new part;
* a chapter does so too, but for a chapter that is the current one already
  (a running header), which does nothing. So a function has two branches, for
  one title: the chapter before is that title, or it is not.

`segmented_blocks` cuts the manuals into page ranges, reduces each range to its
function, takes prefixes of these by a tree of FAN children (tiny rows), and
then labels the lines of each range on its own: no task reads all lines of
a manual, and no window runs over one. `stream_blocks` keeps the same state for
each source file in a stream, with the lines of the open block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lexicon import LexiconProfile
from ..sources import scratch
from . import structure

FAN = 256
PAGES = 32
#: "" stands for a heading that is not there, None for one that a function leaves as it is.
EMPTY, EVEN, ODD = 0, 1, 2
NOTHING = [[EMPTY, 0], [EVEN, 0], [ODD, 0]]
IDENTITY = {"title": None, "same": None, "other": {"set": [None, None, None], "table": NOTHING}}


def step(state: int, token: str) -> tuple[int, int]:
    """(state after, blocks opened) of a line: "b" a bare marker, "m" another
    marker, "x" other text."""
    if token == "x":
        return EVEN, int(state == EMPTY)
    return (ODD if token == "b" and state != ODD else EVEN), int(state != ODD)


STEPS = {(q, t): step(q, t) for q in (EMPTY, EVEN, ODD) for t in "bmx"}


# ------------------------------------------------- functions of the state


def _after(a: dict, b: dict) -> dict:
    """One branch after another."""
    table = [[b["table"][q][0], n + b["table"][q][1]] for q, n in a["table"]]
    return {"set": [y if y is not None else x for x, y in zip(a["set"], b["set"], strict=True)], "table": table}


def _then(branch: dict, chapter: str | None, f: dict) -> dict:
    """A branch and then a function; `chapter` is the one after the branch, None if unknown to be f's title."""
    known = branch["set"][0] if branch["set"][0] is not None else chapter
    return _after(branch, f["same"] if f["title"] is not None and known == f["title"] else f["other"])


def composed(f: dict, g: dict) -> dict:
    """f and then g."""
    if f["title"] is not None:
        return {"title": f["title"], "same": _then(f["same"], f["title"], g), "other": _then(f["other"], None, g)}
    if g["title"] is None:
        return {"title": None, "same": None, "other": _after(f["other"], g["other"])}
    # f has no chapter, so the chapter before g is the one before f
    return {"title": g["title"], "same": _after(f["other"], g["same"]), "other": _after(f["other"], g["other"])}


def of_line(kind: str, head: str, token: str) -> dict:
    fresh = [[EMPTY, 0]] * 3
    if kind == "chapter":
        return {"title": head, "same": {"set": [None, None, None], "table": NOTHING}, "other": {"set": [head, "", ""], "table": fresh}}
    if kind == "section":
        return {**IDENTITY, "other": {"set": [None, head, ""], "table": fresh}}
    if kind == "subsection":
        return {**IDENTITY, "other": {"set": [None, None, head], "table": fresh}}
    return {**IDENTITY, "other": {"set": [None, None, None], "table": [list(step(q, token)) for q in (EMPTY, EVEN, ODD)]}}


class Reader:
    """The state between lines; `read` takes a line and says whether it is
    text of a block and whether it opens one."""

    def __init__(self, headings: Iterable[str] = ("", "", ""), state: int = EMPTY, opened: int = 0):
        self.headings, self.state, self.opened = list(headings), state, opened

    @classmethod
    def after(cls, f: dict) -> Reader:
        """The reader of a manual whose lines so far do f."""
        branch = f["other"]  # there is no chapter at the beginning
        return cls([x or "" for x in branch["set"]], *branch["table"][EMPTY])

    def read(self, kind: str, head: str, token: str) -> tuple[bool, bool]:
        if kind in ("chapter", "section", "subsection"):
            if kind == "chapter" and head == self.headings[0]:
                return False, False
            at = ("chapter", "section", "subsection").index(kind)
            self.headings[at:] = [head] + [""] * (2 - at)
            self.state = EMPTY
            return False, False
        self.state, opens = step(self.state, token)
        self.opened += opens
        return True, bool(opens)


# ------------------------------------------------------------------ scan


def prefixes(df: DataFrame, compose: Callable[[str, str], str], identity: str) -> DataFrame:
    """(source_file, seg, before): the composition of `f` over all smaller
    segments of the source, for rows (source_file, seg, f). Up a tree of FAN
    children and down again; a group never has more than FAN rows."""
    ends = df.agg(F.min("seg"), F.max("seg")).first()
    levels, (least, most) = [df.select("source_file", "seg", "f")], ends if ends[0] is not None else (0, 0)

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg")
        return pd.DataFrame({"source_file": rows["source_file"].iloc[:1], "seg": rows["seg"].iloc[:1] // FAN, "f": [reduce(compose, rows["f"])]})

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg")
        held, before = rows["before"].iloc[0], []
        for f in rows["f"]:
            before.append(held)
            held = compose(held, f)
        return pd.DataFrame({"source_file": rows["source_file"], "seg": rows["seg"], "before": before})

    parent = F.floor(F.col("seg") / FAN).alias("up")
    while least < most:
        least, most = least // FAN, most // FAN
        levels.append(scratch.written(levels[-1].groupBy("source_file", parent).applyInPandas(folded, "source_file string, seg long, f string"), "scan"))
    out = levels.pop().select("source_file", "seg", F.lit(identity).alias("before"))
    while levels:
        up = out.select(F.col("source_file").alias("s"), F.col("seg").alias("up_seg"), "before")
        down = levels.pop().withColumn("up", F.floor(F.col("seg") / FAN))
        down = down.join(up, down["source_file"].eqNullSafe(up["s"]) & (down["up"] == up["up_seg"]))
        out = down.groupBy("source_file", "up").applyInPandas(spread, "source_file string, seg long, before string")
    return out


def _composed(a: str, b: str) -> str:
    return json.dumps(composed(json.loads(a), json.loads(b)), ensure_ascii=False)


def marked(lines: DataFrame, lex: LexiconProfile) -> DataFrame:
    """The lines that count, with `said`, their text, and `token`."""
    marks = F.col("kind").endswith("_marker")
    words = [w for w in (lex.warning, lex.caution, lex.note) if w]
    said = F.when(marks, F.col("head")).otherwise(F.col("line"))
    bare = marks & said.isin([*words, *(w + "！" for w in words)])
    return lines.where(~F.col("kind").isin("blank", "noise")).withColumns({"said": said, "token": F.when(bare, "b").when(marks, "m").otherwise("x")})


class Run:
    """The function of a run of lines, read one by one. Lines without
    headings change a table of three states only."""

    def __init__(self):
        self.f, self.table = IDENTITY, None

    def read(self, kind: str, head: str, token: str) -> None:
        if kind in ("chapter", "section", "subsection"):
            self.f, self.table = composed(self.whole(), of_line(kind, head, token)), None
        else:
            self.table = [(STEPS[q, token][0], n + STEPS[q, token][1]) for q, n in self.table or NOTHING]

    def whole(self) -> dict:
        if self.table is None:
            return self.f
        return composed(self.f, {**IDENTITY, "other": {"set": [None, None, None], "table": [list(x) for x in self.table]}})


def _summed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each range (source_file, seg), of lines in order."""
    key, run = None, Run()

    def table(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in done], pa.string()), pa.array([x[0][1] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["source_file", "seg", "f"])

    for b in batches:
        done = []
        for s, g, kind, head, token in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (s, g):
                if key is not None:
                    done.append((key, json.dumps(run.whole(), ensure_ascii=False)))
                key, run = (s, g), Run()
            run.read(kind, head, token)
        yield table(done)
    if key is not None:
        yield table([(key, json.dumps(run.whole(), ensure_ascii=False))])


def _labelled_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LABELLED of the lines that are text of a block. Ranges come one after
    another, each with the function of what is before it."""
    key, reader = None, None
    for b in batches:
        label, stays = ([], [], [], []), []
        before = b.column("before")
        for i, (s, g, kind, head, token) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source_file", "seg", "kind", "head", "token")), strict=True)):
            if key != (s, g):
                key, reader = (s, g), Reader.after(json.loads(before[i].as_py()))
            text, _ = reader.read(kind, head, token)
            if text:
                stays.append(i)
                for held, value in zip(label, (reader.opened, *(h or None for h in reader.headings)), strict=True):
                    held.append(value)
        kept = b.select(["source_file", "seg", *ORDER, "said"]).take(pa.array(stays, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(label[0], pa.int64()), *(pa.array(x, pa.string()) for x in label[1:])], names=LABELLED)


ORDER = ["page", "doc_id", "n"]
LABELLED = ["source_file", "seg", *ORDER, "said", "block", "chapter", "section", "subsection"]


def segmented_blocks(lines: DataFrame, lex: LexiconProfile, cut: Column | None = None) -> DataFrame:
    """The blocks of `structure.blocks`, found by page ranges. `cut` numbers
    the ranges of a source in the order of its pages (by default PAGES pages
    each)."""
    seg = F.coalesce((F.floor(F.col("page") / PAGES) if cut is None else cut).cast("long"), F.lit(-1 << 40))
    rows = scratch.written(marked(lines, lex).select("source_file", seg.alias("seg"), *ORDER, "kind", "head", "said", "token"), "lines")

    kinds = dict(lines.dtypes)
    schema = f"source_file string, seg long, page {kinds['page']}, doc_id {kinds['doc_id']}, n {kinds['n']}, said string, block long, chapter string, section string, subsection string"

    def in_order(df: DataFrame) -> DataFrame:
        # a range's lines follow one another in one task, which reads range after range from its batches
        return df.repartition("source_file", "seg").sortWithinPartitions("source_file", "seg", *ORDER)

    ends = rows.agg(F.min("seg"), F.max("seg")).first()
    if ends[0] == ends[1]:
        known = rows.withColumn("before", F.lit(json.dumps(IDENTITY)))
    else:
        functions = scratch.written(in_order(rows).select("source_file", "seg", "kind", "head", "token").mapInArrow(_summed_ranges, "source_file string, seg long, f string"), "functions")
        before = prefixes(functions, _composed, json.dumps(IDENTITY)).select(F.col("source_file").alias("s"), F.col("seg").alias("g"), "before")
        known = rows.join(before, rows["source_file"].eqNullSafe(before["s"]) & (rows["seg"] == before["g"])).drop("s", "g")
    x = in_order(known).select("source_file", "seg", *ORDER, "said", "kind", "head", "token", "before").mapInArrow(_labelled_ranges, schema)
    item = F.struct(*ORDER, "said")
    made = x.groupBy("source_file", "block").agg(F.array_sort(F.collect_list(item)).alias("x"), F.min("seg").alias("seg"), *(F.first(h).alias(h) for h in ("chapter", "section", "subsection")))
    made = scratch.written(structure.assembled(made), "blocks")
    counts = made.groupBy("source_file", "seg").agg(F.count(F.lit(1)).cast("string").alias("f"))
    starts = prefixes(counts, _summed, "0").select(F.col("source_file").alias("s"), F.col("seg").alias("g"), F.col("before").cast("int").alias("at"))
    made = made.join(starts, made["source_file"].eqNullSafe(starts["s"]) & (made["seg"] == starts["g"])).drop("s", "g")
    nth = Window.partitionBy("source_file", "seg").orderBy("block")
    return structure.finished(made.withColumn("block_index", F.col("at") + F.row_number().over(nth) - 1).drop("at", "seg", "block"), lex)


def _summed(a: str, b: str) -> str:
    return str(int(a) + int(b))


# ---------------------------------------------------------------- streams

RAW = "source_file string, doc_id string, chapter string, section string, subsection string, raw string, start_page int, end_page int, block_index int, late_lines long"


class BlockReader(StatefulProcessor):
    """Reads the lines of one source file as they come. Lines that are not
    after the last one read are late: they are counted and left out. A line
    with kind `end` closes the source; a timer closes the open block after
    `idle_ms` without a new page, if given."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("reader", "json string")

    def _load(self) -> dict:
        found = self.held.get() if self.held.exists() else None
        return json.loads(found[0]) if found else {"headings": ["", "", ""], "state": EMPTY, "lines": [], "last": None, "kept": 0, "late": 0}

    def _closed(self, key: str | None, s: dict) -> list[dict]:
        """The open block, if it is long enough for one."""
        lines, s["lines"], s["state"] = s["lines"], [], EMPTY
        raw = "\n".join(x[2] for x in lines).strip()
        if len(raw) < structure.LEAST_BLOCK:
            return []
        s["kept"] += 1
        chapter, section, subsection = (h or None for h in s["headings"])
        return [{"source_file": key, "doc_id": lines[0][1], "chapter": chapter, "section": section, "subsection": subsection, "raw": raw, "start_page": lines[0][0], "end_page": lines[-1][0], "block_index": s["kept"] - 1, "late_lines": s["late"]}]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        given = pd.concat(list(rows)).sort_values(ORDER, na_position="first")
        for page, doc, n, kind, head, said, token in zip(*(given[c] for c in ("page", "doc_id", "n", "kind", "head", "said", "token")), strict=True):
            at = [int(page), doc, int(n)]
            if s["last"] is not None and at <= s["last"]:
                s["late"] += 1
                continue
            s["last"] = at
            if kind == "end":
                out += self._closed(key[0], s)
                continue
            if kind in ("blank", "noise"):
                continue
            reader = Reader(s["headings"], s["state"])
            text, opens = reader.read(kind, head, token)
            if opens or (not text and reader.state == EMPTY and s["state"] != EMPTY):
                out += self._closed(key[0], s)
            s["headings"], s["state"] = reader.headings, reader.state
            if text:
                s["lines"].append([int(page), doc, said])
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        if self.idle_ms is not None and s["lines"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        self.held.update((json.dumps(s, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = self._closed(key[0], s)
        self.held.update((json.dumps(s, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])

    def close(self) -> None:
        pass


PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_blocks(pages: DataFrame, lex: LexiconProfile, skip_toc_pages: int = structure.SKIP_TOC_PAGES, last: str | None = None, idle: int | None = None) -> DataFrame:
    """Blocks of a stream of pages (doc_id, source_file, page, text), which
    come in the order of their pages (a null page counts as -1). `last` names a boolean column that is
    true for a source's last page. With `idle`, the open block of a source also
    comes that many seconds after its last page; such a stream looks at its
    timers for ever, so it is for triggers by time and not for one that ends
    with the data. Needs the state store of PROVIDER."""
    lines = marked_for_stream(structure.classified_lines(pages, lex, skip_toc_pages), lex)
    if last is not None:
        end = pages.where(F.col(last)).select("doc_id", "source_file", "page", F.lit(1 << 30).alias("n"), F.lit("end").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("head", "said", "token")))
        lines = lines.unionByName(end.select(lines.columns))
    found = lines.groupBy("source_file").transformWithStateInPandas(BlockReader(idle and idle * 1000), RAW, "Append", "ProcessingTime" if idle else "None")
    return structure.finished(found, lex)


def marked_for_stream(lines: DataFrame, lex: LexiconProfile) -> DataFrame:
    return marked(lines, lex).select(F.col("doc_id").cast("string").alias("doc_id"), "source_file", F.coalesce(F.col("page").cast("int"), F.lit(-1)).alias("page"), "n", "kind", "head", "said", "token")
