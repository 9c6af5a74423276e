"""Operator 2: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. A line's observation, a number under 64, is made of its speaker
marker, whether it follows a break, its length and whether it asks, taken as independent given the
state. Hidden states are a role with "first line of a turn" or "later line". Emissions and transitions are smoothed counts over all labelled rows: a few hundred
numbers. Viterbi finds the most likely states, and a turn is a first line with the later lines after.

Observations travel without their texts, one byte a line. A transcript's lines are cut into blocks by
position. A transcript of one block is decoded at once, many side by side. Viterbi's step is a max-plus
matrix product, which is associative: for a longer transcript every block becomes one matrix of 7 x 7,
``SPAN`` blocks one more, these give the states at the spans' borders, and they those at the blocks'
borders; then every block is decoded between its two. The result is that of one pass, and the largest
things in a task are a block's lines and a span's matrices. At last texts are dealt to their blocks
once and cut into turns by the states; only the parts of turns that go over a border meet again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .native import let

ROLES = ("system", "user", "assistant")
#: State 2 r is the first line of a turn of role r, state 2 r + 1 a later one.
STATES = 2 * len(ROLES)
#: The state before a transcript's first line; nothing leads back to it.
START = STATES
NEVER = -1e30

#: Names that stand for a role in markers, lower case.
ALIASES = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "you", "q"), "assistant": ("assistant", "ai", "bot", "model", "a")}
_NAMES = "|".join(sorted((a for names in ALIASES.values() for a in names), key=len, reverse=True))
#: `User: `, `[user] `, `<user> `, `### User: ` and the like, at the start of a line.
MARKER = rf"(?i)^\s*(?:#{{1,4}}\s*|\*\*)?(?:[<\[(]\|?({_NAMES})\|?[>\])]:?|({_NAMES})(?:\*\*)?\s*[:>])\s*"

#: Positions of a transcript that make one block, and blocks that make a span.
BLOCK, SPAN = 512, 1024

#: Lines that are decoded side by side.
LINES_AT_ONCE = 200_000

LENGTHS = (40, 160, 480)
#: The parts of an observation, in this order: marker, break before, length, question.
PARTS = (len(ROLES) + 1, 2, len(LENGTHS) + 1, 2)
CODES = PARTS[0] * PARTS[1] * PARTS[2] * PARTS[3]

#: What smoothing adds to every count.
SMOOTH = 0.2


class Model(NamedTuple):
    """Log probabilities over the states and START."""

    step: list[list[float]]
    emit: list[list[float]]


def marked_role(line: Column) -> Column:
    """0 without a marker, else the role's number plus one."""

    def number(name: Column) -> Column:
        found = F.lit(0)
        for i, role in enumerate(ROLES):
            found = F.when(name.isin(*ALIASES[role]), i + 1).otherwise(found)
        return found

    return let(F.lower(F.concat(F.regexp_extract(line, MARKER, 1), F.regexp_extract(line, MARKER, 2))), number)


def observation(line: Column, after_break: Column) -> Column:
    size = F.char_length(line)
    length = sum((F.when(size > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    asks = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
    return ((marked_role(line) * 2 + F.when(after_break, 1).otherwise(0)) * (len(LENGTHS) + 1) + length) * 2 + asks


def fit(df: DataFrame, key: str, position: str, role: str, text: str) -> Model:
    """Smoothed log probabilities from labelled rows; only the counts reach the driver.

    Rows without a known role are left out. Successive rows are found by an equality join on key and
    position, so a transcript that holds a third of all rows is no special case.
    """
    number = F.lit(None).cast("int")
    for i, name in enumerate(ROLES):
        number = F.when(F.lower(role) == name, i).otherwise(number)
    known = df.select(F.col(key).alias("k"), F.col(position).cast("long").alias("p"), number.alias("r"), F.coalesce(text, F.lit("")).alias("t")).where("r is not null")
    lines = known.select("r", F.posexplode(F.split("t", "\n")).alias("sub", "line"))
    coded = lines.select((F.col("r") * 2 + F.when(F.col("sub") > 0, 1).otherwise(0)).alias("state"), observation(F.col("line"), F.col("sub") == 0).alias("code"))
    counts = np.zeros((STATES, CODES))
    for state, code, n in coded.groupBy("state", "code").count().collect():
        counts[state, code] += n
    turns = known.select("k", "p", "r")
    pairs = turns.join(turns.select("k", (F.col("p") - 1).alias("p"), F.col("r").alias("s")), ["k", "p"]).groupBy("r", "s").count()
    role_step = np.ones((len(ROLES), len(ROLES)))
    for a, b, n in pairs.collect():
        role_step[a, b] += n
    role_step /= role_step.sum(axis=1, keepdims=True)
    start = np.array([1.0, 0.0] * len(ROLES))
    for r, n in turns.where("p = 0").groupBy("r").count().collect():
        start[2 * r] += n
    step = np.full((STATES, STATES), 1e-12)
    for a in range(len(ROLES)):
        first, later = counts[2 * a].sum() + 1, counts[2 * a + 1].sum() + 1
        stay = later / (first + later)
        for state in (2 * a, 2 * a + 1):
            step[state, 2 * a + 1] = stay
            step[state, 0::2] = (1 - stay) * role_step[a]
    emit = emissions(counts)
    all_step, all_emit = np.zeros((STATES + 1, STATES + 1)), np.zeros((STATES + 1, CODES))
    all_step[:STATES, :STATES], all_step[START, :STATES], all_emit[:STATES] = step, start / start.sum(), emit
    logs = [np.where(x > 0, np.log(np.where(x > 0, x, 1)), NEVER).tolist() for x in (all_step, all_emit)]
    return Model(*logs)


def emissions(counts: np.ndarray) -> np.ndarray:
    """Probabilities of observations by state: the parts of an observation count as independent."""
    out = np.ones((STATES, *PARTS))
    grid = counts.reshape(STATES, *PARTS)
    for part in range(len(PARTS)):
        others = tuple(1 + p for p in range(len(PARTS)) if p != part)
        share = grid.sum(axis=others, keepdims=True) + SMOOTH
        out *= share / share.sum(axis=1 + part, keepdims=True)
    return out.reshape(STATES, CODES)


def block_matrix(codes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best log probability from the state before the block to the state at its end.

    Lines are folded pairwise, a few thousand at once, so loops are short and arrays small.
    """
    whole = None
    for at in range(0, len(codes), 2048):
        parts = step[None, :, :] + emit[:, codes[at : at + 2048]].T[:, None, :]
        if whole is not None:
            parts = np.concatenate([whole[None], parts])
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else parts[:0]
            even = parts[: len(parts) - len(odd)]
            parts = np.concatenate([(even[0::2, :, :, None] + even[1::2, None, :, :]).max(axis=2), odd])
        whole = parts[0]
    return whole


def between(matrices: list[np.ndarray], before: int = START, last: int | None = None) -> list[tuple[int, int]]:
    """The best states before and at the end of each part, given those around all of them."""
    score, back = np.where(np.arange(STATES + 1) == before, 0.0, NEVER), []
    for m in matrices:
        scores = score[:, None] + m
        back.append(scores.argmax(axis=0))
        score = scores.max(axis=0)
    ends = [int(score.argmax()) if last is None else last]
    for b in reversed(back[1:]):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends, strict=True))


def decode_blocks(codes: list[np.ndarray], before: np.ndarray, last: np.ndarray, step: np.ndarray, emit: np.ndarray) -> list[np.ndarray]:
    """The best states of every block's lines between the state before it and its last one (-1: any)."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([codes[i] for i in order])
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    deep = np.array([np.count_nonzero(sizes > t) for t in range(int(sizes.max()))])  # blocks with a line t
    best = np.where(np.arange(STATES + 1)[None, :] == before[order][:, None], 0.0, NEVER)
    back = []
    for t, n in enumerate(deep.tolist()):
        scores = best[:n, :, None] + step[None]
        back.append(scores.argmax(axis=1).astype(np.int8))
        best[:n] = scores.max(axis=1) + emit[:, flat[starts[:n] + t]].T
    state = np.where(last[order] >= 0, last[order], best.argmax(axis=1))
    out = np.empty(len(flat), np.int8)
    for t in range(len(deep) - 1, -1, -1):
        n = int(deep[t])
        out[starts[:n] + t] = state[:n]
        state[:n] = back[t][np.arange(n), state[:n]]
    found: list = [None] * len(codes)
    for i, a, b in zip(order.tolist(), starts.tolist(), ends.tolist(), strict=True):
        found[i] = out[a:b]
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows by their first ``keys`` columns, whole groups even across batches."""
    name, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != name:
                if held:
                    yield name, held
                name, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield name, held


def _borders(blocks: DataFrame, step: np.ndarray, emit: np.ndarray) -> DataFrame:
    """``__key, __block, before, last`` of the blocks of transcripts that have several."""
    kind = blocks.schema["__key"].dataType
    arrow, typed = key_type(kind), f"__key {kind.simpleString()}"

    def batch_of(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def square(m: list[float]) -> np.ndarray:
        return np.array(m).reshape(STATES + 1, STATES + 1)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*names, block_matrix(np.frombuffer(codes, np.uint8), step, emit).ravel().tolist()) for *names, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield batch_of(["__key", "__span", "__block", "m"], rows, [arrow, pa.int64(), pa.int64(), pa.list_(pa.float64())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, span), rows in _groups(batches, 2):
            whole = square(rows[0][1])
            for _, m in rows[1:]:
                whole = (whole[:, :, None] + square(m)[None]).max(axis=1)
            yield batch_of(["__key", "__span", "m"], [(name, span, whole.ravel().tolist())], [arrow, pa.int64(), pa.list_(pa.float64())])

    def span_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in _groups(batches, 1):
            found = between([square(m) for _, m in rows])
            yield batch_of(["k2", "s2", "sb", "sl"], [(name, r[0], *f) for r, f in zip(rows, found, strict=True)], [arrow, pa.int64(), pa.int32(), pa.int32()])

    def block_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), rows in _groups(batches, 2):
            found = between([square(m) for _, m, _, _ in rows], rows[0][2], rows[0][3])
            yield batch_of(["k2", "b2", "before", "last"], [(name, r[0], *f) for r, f in zip(rows, found, strict=True)], [arrow, pa.int64(), pa.int32(), pa.int32()])

    sizes = blocks.groupBy(F.col("__key").alias("k1")).agg(F.min("__block").alias("lo"), F.max("__block").alias("hi")).where("lo < hi").select("k1")
    several = blocks.join(sizes, F.col("__key").eqNullSafe(F.col("k1"))).select("__key", F.expr(f"__block div {SPAN}").alias("__span"), "__block", "codes")
    each = materialize(several.mapInArrow(matrices, f"{typed}, __span long, __block long, m array<double>"), "matrices")
    order = ["__key", "__span", "__block"]
    whole = each.repartition("__key", "__span").sortWithinPartitions(*order).mapInArrow(spans, f"{typed}, __span long, m array<double>")
    ends = whole.repartition("__key").sortWithinPartitions("__key", "__span").mapInArrow(span_borders, f"k2 {kind.simpleString()}, s2 long, sb int, sl int")
    joined = each.join(ends, F.col("__key").eqNullSafe(F.col("k2")) & (F.col("__span") == F.col("s2"))).select(*order, "m", "sb", "sl")
    return joined.repartition("__key", "__span").sortWithinPartitions(*order).mapInArrow(block_borders, f"k2 {kind.simpleString()}, b2 long, before int, last int")


def _states(blocks: DataFrame, step: np.ndarray, emit: np.ndarray) -> DataFrame:
    """``__key, __block, states``, a byte a line, and ``turns``, how many begin in the block."""
    kind = blocks.schema["__key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(x, np.uint8) for x in batch.column(2).to_pylist()]
            before, last = (batch.column(i).to_numpy() for i in (3, 4))
            bounds, held = [0], 0
            for i, c in enumerate(codes):
                held += len(c)
                if held >= LINES_AT_ONCE:
                    bounds.append(i + 1)
                    held = 0
            for a, b in zip(bounds, [*bounds[1:], len(codes)], strict=True):
                if a < b:
                    found = decode_blocks(codes[a:b], before[a:b], last[a:b], step, emit)
                    turns = pa.array([int(np.count_nonzero(x % 2 == 0)) for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary()), turns], ["__key", "__block", "states", "turns"])

    borders = _borders(blocks, step, emit)
    joined = blocks.join(borders, F.col("__key").eqNullSafe(F.col("k2")) & (F.col("__block") == F.col("b2")), "left")
    given = joined.select("__key", "__block", "codes", F.coalesce("before", F.lit(START)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))
    return given.mapInArrow(run, f"__key {kind.simpleString()}, __block long, states binary, turns long")


def _parts(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Parts of turns: ``__key, turn, part, r, text`` and ``cut``, whether the turn may have parts in other blocks."""
    kind = rows.schema["__key"].dataType
    within = Window.partitionBy("__key").orderBy("__block")
    base = F.coalesce(F.sum("turns").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.lead("__block").over(within).isNotNull()
    none = lambda t: F.lit(None).cast(t)
    heads = states.select("__key", "__block", F.lit(0).alias("kind"), none("long").alias("__pos"), none("long").alias("__tie"), base.cast("long").alias("base"), more.alias("more"), "states", none("string").alias("text"))
    bodies = rows.select("__key", "__block", F.lit(1).alias("kind"), "__pos", "__tie", none("long").alias("base"), none("boolean").alias("more"), none("binary").alias("states"), "text")
    dealt = heads.union(bodies).repartition("__key", "__block").sortWithinPartitions("__key", "__block", "kind", "__pos", "__tie")
    fields = ["__key", "turn", "part", "r", "text", "cut"]
    kinds = [key_type(kind), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name, block, turn, found, at, more = None, 0, 0, b"", 0, False
        held: list[str] = []  # the texts of the turn at hand
        role, cut, size = 0, False, 0

        def close(is_cut: bool) -> None:
            nonlocal held
            if held:
                out.append((name, turn, block, role, "\n".join(held), is_cut))
                held = []

        for batch in batches:
            for key, number, is_text, base, is_more, states, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_text:
                    close(cut or more)
                    name, block, turn, found, at, more, cut = key, number, base - 1, states, 0, is_more, True
                    continue
                lines = text.split("\n")
                own = found[at : at + len(lines)]
                at += len(lines)
                size += len(text)
                if not own[0] % 2 and not any(not s % 2 for s in own[1:]):  # one turn, or the start of one
                    close(cut)
                    turn, role, cut, held = turn + 1, own[0] // 2, False, [text]
                    continue
                for line, s in zip(lines, own, strict=True):
                    if not s % 2:
                        close(cut)
                        turn, cut = turn + 1, False
                    if not held:
                        role = s // 2
                    held.append(line)
            if size > 2_000_000 and out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], fields)
                out.clear()
                size = 0
        close(cut or more)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], fields)

    kept = dealt.select("__key", "__block", "kind", "base", "more", "states", "text")
    return kept.mapInArrow(run, f"__key {kind.simpleString()}, turn long, part long, r int, text string, cut boolean")


def parse_transcripts(df: DataFrame, model: Model, key: str = "conv_id", position: str = "turn", text: str = "text") -> DataFrame:
    """Rows of transcripts in order of ``position`` -> turns ``key, turn, role, text, rendered``.

    A row may hold any number of lines; the start of a row counts as a break. Markers are taken off.
    Null texts are empty lines; null keys form one transcript; null positions come first; rows of
    one position, which stand in one block, are ordered by their texts' hashes; an empty table gives no
    turns; other columns are ignored.
    """
    step, emit = np.array(model.step), np.array(model.emit)
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    codes = F.transform(lines, lambda x, i: F.lpad(F.hex(observation(x, i == 0)), 2, "0"))
    bare = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, MARKER, "")), "\n")
    at = F.coalesce(F.col(position).cast("long"), F.lit(-1).cast("long"))
    rows = df.select(F.col(key).alias("__key"), F.expr("0L").alias("__block"), at.alias("__pos"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__tie"), F.array_join(codes, "").alias("codes"), bare.alias("text"))
    rows = rows.withColumn("__block", F.expr(f"__pos div {BLOCK}"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__tie", "codes"))), lambda x: x["codes"]), "")
    blocks = materialize(rows.groupBy("__key", "__block").agg(F.unhex(joined).alias("codes")), "blocks")
    states = materialize(_states(blocks, step, emit), "states")
    release(blocks)
    parts = _parts(rows.drop("codes"), states)
    split = parts.where("cut").groupBy("__key", "turn").agg(F.min_by("r", "part").alias("r"), F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
    merged = split.select("__key", "turn", "r", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    turns = parts.where("not cut").select("__key", "turn", "r", "text").union(merged)
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("r") + 1)
    out = turns.select(F.col("__key").alias(key), "turn", role.alias("role"), "text")
    return out.withColumn("rendered", render(F.col("role"), F.col("text")))


def key_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def render(role: Column, text: Column) -> Column:
    """One turn in ChatML."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


#: How the query's transcripts write speakers: a form for each, filled with the role's name in it.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instructions: ", "### Human: ", "### AI: "), ("[system] ", "[user] ", "[assistant] "), ("<system> ", "<customer> ", "<bot> "))


def raw_transcripts(df: DataFrame) -> DataFrame:
    """``conversations`` as transcripts: the role column becomes a marker in one of four styles, a
    style for each conversation, and every fifth turn, by hash, has none."""
    index = {"system": 0, "user": 1, "assistant": 2}
    marker = F.lit("")
    for s, style in enumerate(STYLES):
        for role, i in index.items():
            marker = F.when((F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) == s) & (F.lower("role") == role), style[i]).otherwise(marker)
    marked = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0, "").otherwise(marker)
    return df.select("conv_id", "turn", F.concat(marked, F.coalesce("text", F.lit(""))).alias("text"), "role")


def op2_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, written as a raw transcript, parsed back to canonical turns by a model of every
    second conversation, chosen by hash."""
    raw = raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    labelled = raw.where(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0)
    return parse_transcripts(raw.drop("role"), fit(labelled, "conv_id", "turn", "role", "text"))
