"""Repair of conversations whose turns are blank, repeated, cut off or in no legal role order.

Per conversation the cheapest edits that make the role initials read ``(s?(ua)+)?`` (see
``role_viterbi``), as a report (``repair``) or as the repaired turns (``turns``).

1. All turns are sorted over the cluster by range: by conversation, turn (nulls first),
   role, the text's first 64 characters, its hash, and the place of the row, so that ties
   have a defined order and any hot value can be cut.  A task has a run of that order.
2. Conversations within one task are settled there, many at a time.  Only the first and
   the last of a task may go on in another one: their rows are written down as *open*.
3. Open conversations, however long, are pieces of at most ``PIECE`` turns, which are worked
   on apart: repeated turns are found by joining the texts of one piece with the first piece
   that has them; a piece is a byte per turn; it starts from a speculative end, and passes
   over the written pieces run those again whose end turned out otherwise, until none
   did.  Each piece's map from the state before it to that behind it is put together over
   the pieces of a conversation (four numbers a piece), which gives every piece its trace.
4. The repaired text of an open conversation is hashed piece by piece in a stream.

Null roles and texts count as one space; null turns come first and don't count for gaps; a
null conversation id is a conversation of its own.  Texts and roles have any length;
repeated rows are duplicates of the first; an empty table gives an empty table; columns other
than the four named ones are not read, whatever their names.  Turns have to be whole numbers
(others count as null); gaps beyond a long are the largest long.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import role_viterbi as rv
from .common import _quoted, prepare

SPACE = " \t\n\x0b\x0c\r"
#: Turns of a piece of an open conversation.
PIECE = 1 << 16
#: Turns and characters that a task settles together.
HELD_TURNS, HELD_CHARS = 20_000, 8 << 20
#: Characters of repaired text in one row on its way to the hash.
BLOB = 64 << 10
_LONGEST = (1 << 63) - 1

SOUND, TRUNCATED, BLANK, REPEATED, ABSENT = range(5)
_KIND = np.array([0, 1, 2, 2, 2])
_NAMES = {0: "system", 1: "user", 2: "assistant"}
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "key string, part long, pos long, turn long, role string, text string, initial int, fault int"
TURN = "place long, turn long, role string, text string, edit string"


def damage(df: DataFrame) -> DataFrame:
    """``conversations`` with planted faults by crc32(``conv_id:turn``) % 20 (nulls: one space):
    0 the row is gone (``present`` is false), 1 empty text, 2 without ``.!?``, 3 twice, 4 role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), n.alias("n"))
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("n") != 0).alias("present"),
                       F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _sorted(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Rows in the order of the conversations, each with its initial and its own fault."""
    c = [df[_quoted(x)] for x in (conv, turn, role, text)]
    key = F.coalesce(F.concat(F.lit("="), c[0].cast("string")), F.lit(""))
    rows = df.select(key.alias("key"), c[1].try_cast("long").alias("turn"), F.coalesce(c[2].cast("string"), F.lit(" ")).alias("role"), F.coalesce(c[3].cast("string"), F.lit(" ")).alias("text"),
                     F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("present"), F.monotonically_increasing_id().alias("place"))
    first, end = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~F.col("present"), ABSENT).when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    rows = rows.select("*", initial.alias("initial"), fault.alias("fault"), F.left("text", F.lit(64)).alias("head"), F.xxhash64("text").alias("h"))
    order = ["key", "turn", "role", "head", "h", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "role", "text", "initial", "fault")


class _Conversation:
    """Rows of one conversation that are still to be settled or written down."""

    def __init__(self, key: str):
        self.key, self.rows, self.pos, self.seen, self.known = key, [], 0, set(), False

    def add(self, turn, role, text, initial, fault) -> None:
        if fault == ABSENT:
            return
        if fault <= TRUNCATED:
            if (role, text) in self.seen:
                fault = REPEATED
            else:
                self.seen.add((role, text))
        self.rows.append((turn, role, text, initial, fault))

    def taken(self, part: int) -> list[tuple]:
        """The rows as open rows; the first call names the conversation, even without rows."""
        out = [(self.key, part << 24 | (self.pos + k) // PIECE, self.pos + k, *r) for k, r in enumerate(self.rows)]
        if not out and not self.known:
            out = [(self.key, part << 24, -1, None, "", "", 3, ABSENT)]
        self.known, self.pos, self.rows = True, self.pos + len(self.rows), []
        return out


def _codes(rows: list[tuple]) -> np.ndarray:
    return np.array([3 * r[3] for r in rows], np.int64) + _KIND[np.array([r[4] for r in rows], np.int64)]


def _edited(rows: list[tuple], states: list[int], inserts: list[int], letters: list[int], closing: int) -> Iterator[tuple]:
    """Repaired turns (turn, role, text, edit) of rows with their trace; deleted ones are left out."""
    state = 0
    for (turn, role, text, _, _), state, n, letter in zip(rows, states, inserts, letters, strict=True):
        for _ in range(n):
            name, state = rv.next_role(state)
            yield None, name, "", "I"
        if letter == rv.K:
            yield turn, role, text, "K"
        elif letter == rv.R:
            yield turn, rv.next_role(state)[0], text, "R"
    for k in range(closing):  # behind an opening s: user, assistant; behind u: assistant
        yield None, ("assistant" if closing - k == 1 else "user"), "", "I"


def _facts(rows: list[tuple]) -> dict:
    """Counts of a run of rows, with what is needed to join it to its neighbours."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[3] for r in rows]
    faults = [r[4] for r in rows]
    legal = {(0, 1), (1, 2), (2, 1)}
    return {"blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(TRUNCATED),
            "illegal": sum(p not in legal for p in zip(initials, initials[1:])),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "n_turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns),
            "first": initials[0] if rows else None, "last": initials[-1] if rows else None}


def _settle(done: list[_Conversation], keep_turns: bool) -> Iterator[pa.RecordBatch]:
    """Reports, and on demand turns, of whole conversations."""
    rows = [r for c in done for r in c.rows]
    runs = rv.Runs(_codes(rows), np.array([len(c.rows) for c in done], np.int64), np.tile(rv.TERMINAL, (len(done), 1)))
    vectors, low = runs.starts()
    states, inserts, letters, behind = runs.trace(np.zeros(len(done), np.int64))
    out: dict[str, list] = {n: [] for n in _names(keep_turns)}
    for k, c in enumerate(done):
        at = slice(int(runs.first[k]), int(runs.first[k]) + len(c.rows))
        closing, f = rv.CLOSING[behind[k]], _facts(c.rows)
        edited = list(_edited(c.rows, states[at].tolist(), inserts[at].tolist(), letters[at].tolist(), closing))
        out["key"].append(c.key)
        if keep_turns:
            out["turns"].append([dict(zip(("place", "turn", "role", "text", "edit"), (p, *e), strict=True)) for p, e in enumerate(edited)])
            continue
        gaps = min(f["last_turn"] - f["first_turn"] + 1 - f["n_turns"], _LONGEST) if f["n_turns"] else 0
        audit = rv.audit(inserts[at], letters[at]).decode() + "I" * closing
        digest = hashlib.sha256("\n".join(f"{e[1]}:{e[2]}" for e in edited).encode("utf-8", "surrogatepass")).hexdigest()
        for name, x in zip(_names(False)[1:9], (gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], int(vectors[k, 0] + low[k]), audit, digest), strict=True):
            out[name].append(x)
    yield _batch(len(done), out, keep_turns)


def _names(keep_turns: bool) -> list[str]:
    return ["key", "turns"] if keep_turns else ["key", *[f.split()[0] for f in REPORT.split(", ")]]


def _step_schema(keep_turns: bool) -> str:
    return f"key string, {f'turns array<struct<{_typed(TURN)}>>' if keep_turns else REPORT}, open struct<{_typed(ROW)}>"


def _typed(fields: str) -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in fields.split(", "))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _struct(fields: str) -> pa.DataType:
    return pa.struct([(f.split()[0], _ARROW[f.split()[1]]) for f in fields.split(", ")])


def _batch(n: int, columns: dict[str, list], keep_turns: bool, opened: list[dict] | None = None) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "turns": pa.list_(_struct(TURN))} | {f.split()[0]: _ARROW[f.split()[1]] for f in REPORT.split(", ")}
    names = _names(keep_turns)
    arrays = [pa.array(columns.get(x) or [None] * n, kinds[x]) for x in names]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(opened or [None] * n, _struct(ROW))], [*names, "open"])


def _open_batch(rows: list[tuple], keep_turns: bool) -> pa.RecordBatch:
    names = [f.split()[0] for f in ROW.split(", ")]
    return _batch(len(rows), {}, keep_turns, [dict(zip(names, r, strict=True)) for r in rows])


def _local(batches: Iterator[pa.RecordBatch], keep_turns: bool) -> Iterator[pa.RecordBatch]:
    """Step 2 over one task's run of sorted rows."""
    part, now, first = TaskContext.get().partitionId(), None, True
    done: list[_Conversation] = []
    turns = chars = 0
    for batch in batches:
        for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or key != now.key:
                if now is not None and first:
                    yield _open_batch(now.taken(part), keep_turns)
                    first = False
                elif now is not None:
                    done.append(now)
                    if turns >= HELD_TURNS or chars >= HELD_CHARS:
                        yield from _settle(done, keep_turns)
                        done, turns, chars = [], 0, 0
                now = _Conversation(key)
            now.add(*row)
            turns, chars = turns + 1, chars + len(row[2])
            if first and len(now.rows) >= 1000:
                yield _open_batch(now.taken(part), keep_turns)
    if done:
        yield from _settle(done, keep_turns)
    while now is not None and (now.rows or not now.known):
        rest = now.rows[1000:]
        now.rows = now.rows[:1000]
        yield _open_batch(now.taken(part), keep_turns)
        now.rows = rest


def _piece(table: pa.Table) -> pa.Table:
    """Rows of one piece, to a byte per turn and its counts."""
    table = table.sort_by("pos")
    key, part = table.column("key")[0].as_py(), table.column("part")[0].as_py()
    rows = [r for r in zip(*[table.column(c).to_pylist() for c in ("turn", "role", "text", "initial", "fault")], strict=True) if r[4] != ABSENT]
    facts = _facts(rows)
    return pa.table({"key": [key], "part": [part], "codes": [_codes(rows).astype(np.uint8).tobytes()]} | {k: pa.array([v], pa.int64()) for k, v in facts.items()})


_PIECE = "key string, part long, codes binary, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, n_turns long, first long, last long"
_FIT = "key string, part long, codes binary, ahead array<int>, vector array<int>, low long, changed boolean"


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, codes, ahead, vector, low, want): vectors of pieces whose end is not ``want``, anew."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes, want = np.frombuffer(r["codes"], np.uint8).astype(np.int64), r.pop("want")
            r["changed"] = r["vector"] is None or want != r["ahead"]
            if r["vector"] is None:
                vectors, low = rv.Runs(codes, np.array([len(codes)]), np.array([want], np.int32)).starts()
                r |= {"vector": vectors[0].tolist(), "low": int(low[0]), "ahead": want}
            elif r["changed"]:
                vector, more = refit(codes, r["ahead"], want)
                r |= {"low": more, "vector": vector} if vector else {"low": r["low"] + more}
                r["ahead"] = want
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int64()), ("codes", pa.binary()), ("ahead", pa.list_(pa.int32())), ("vector", pa.list_(pa.int32())), ("low", pa.int64()), ("changed", pa.bool_())]))


def refit(codes: np.ndarray, old: list[int], new: list[int]) -> tuple[list[int] | None, int]:
    vector, low = rv.refit(codes, np.array(old, np.int32), np.array(new, np.int32))
    return (None if vector is None else vector.tolist()), low


def _fit(pieces: DataFrame) -> DataFrame:
    """Step 3's passes: (key, part, codes, ahead, vector, low) with each piece's true end."""
    behind = Window.partitionBy("key").orderBy("part")
    terminal = F.array(*[F.lit(int(x)) for x in rv.TERMINAL])
    guess = F.when(F.lead("part").over(behind).isNull(), terminal).otherwise(F.array(*[F.lit(0)] * 4))
    none = F.lit(None)
    start = pieces.select("key", "part", "codes", none.cast("array<int>").alias("ahead"), none.cast("array<int>").alias("vector"), none.cast("long").alias("low"), guess.alias("want"))
    now = materialize(start.mapInArrow(_fitted, _FIT), "conversation-pass")
    while True:
        want = F.coalesce(F.lead("vector").over(behind), terminal)
        now = materialize(now.drop("changed").withColumn("want", want).mapInArrow(_fitted, _FIT), "conversation-pass")
        if now.where("changed").isEmpty():
            return now.drop("changed")


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for codes, ahead in zip(batch.column("codes").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
            codes = np.frombuffer(codes, np.uint8).astype(np.int64)
            maps.append(rv.Runs(codes, np.array([len(codes)]), np.array([ahead], np.int32)).maps()[0].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), pa.array(maps, pa.list_(pa.int32()))], ["key", "part", "map"])


def _composed(table: pa.Table) -> pa.Table:
    """The state before each piece of one conversation, from the maps of those before it."""
    table, state, states = table.sort_by("part"), 0, []
    for m in table.column("map").to_pylist():
        states.append(state)
        state = m[state]
    return table.select(["key", "part"]).append_column("state", pa.array(states, pa.int32()))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes = np.frombuffer(r["codes"], np.uint8).astype(np.int64)
            runs = rv.Runs(codes, np.array([len(codes)]), np.array([r["ahead"]], np.int32))
            states, inserts, letters, behind = runs.trace(np.array([r["state"]]))
            closing = rv.CLOSING[behind[0]] if r["is_last"] else 0
            out.append({"key": r["key"], "part": r["part"], "audit": rv.audit(inserts, letters).decode() + "I" * closing, "closing": closing,
                        "trace": (states | inserts << 2 | letters << 4).astype(np.uint8).tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int64()), ("audit", pa.string()), ("closing", pa.int32()), ("trace", pa.binary())]))


def _retold(rows: pa.Table, trace: pa.Table) -> Iterator[tuple]:
    """Repaired turns of one piece."""
    rows = rows.sort_by("pos")
    rows = [r for r in zip(*[rows.column(c).to_pylist() for c in ("turn", "role", "text", "initial", "fault")], strict=True) if r[4] != ABSENT]
    t = np.frombuffer(trace.column("trace")[0].as_py(), np.uint8).astype(np.int64)
    return _edited(rows, (t & 3).tolist(), (t >> 2 & 3).tolist(), (t >> 4).tolist(), trace.column("closing")[0].as_py())


def _blobs(rows: pa.Table, trace: pa.Table) -> pa.Table:
    """Repaired text of one piece in rows of about ``BLOB`` characters; the first has its audit."""
    blobs, held, size = [], [], 0
    for _, role, text, _ in _retold(rows, trace):
        held.append(f"{role}:{text}")
        size += len(text)
        if size >= BLOB:
            blobs.append("\n".join(held))
            held, size = [], 0
    if held:
        blobs.append("\n".join(held))
    n = max(len(blobs), 1)
    return pa.table({"key": trace.column("key").to_pylist() * n, "part": trace.column("part").to_pylist() * n, "k": pa.array(range(n), pa.int64()),
                     "audit": pa.array([trace.column("audit")[0].as_py(), *[""] * (n - 1)], pa.string()), "blob": pa.array(blobs or [None], pa.string())})


def _piece_turns(rows: pa.Table, trace: pa.Table) -> pa.Table:
    told = list(_retold(rows, trace))
    turn, role, text, edit = zip(*told, strict=True) if told else ((),) * 4
    n, kinds = len(told), _struct(TURN)
    columns = {"place": range(n), "turn": turn, "role": role, "text": text, "edit": edit}
    return pa.table({"key": pa.array(trace.column("key").to_pylist() * n, pa.string()), "part": pa.array(trace.column("part").to_pylist() * n, pa.int64())}
                    | {k: pa.array(list(v), kinds.field(k).type) for k, v in columns.items()})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its blobs in order."""
    now, audit, digest, some = None, [], None, False
    def told():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["key", "audit", "repaired_sha256"])
    for batch in batches:
        for key, piece, blob in zip(*[batch.column(c).to_pylist() for c in ("key", "audit", "blob")], strict=True):
            if key != now:
                if now is not None:
                    yield told()
                now, audit, digest, some = key, [], hashlib.sha256(), False
            audit.append(piece)
            if blob is not None:
                digest.update((("\n" if some else "") + blob).encode("utf-8", "surrogatepass"))
                some = True
    if now is not None:
        yield told()


def _stepped(df: DataFrame, columns: tuple[str, str, str, str], present: Column | None, keep_turns: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The step table, and of open conversations their rows, pieces and traces."""
    prepare(df.sparkSession)
    rows = _sorted(df, *columns, present)
    step = materialize(rows.mapInArrow(lambda b: _local(b, keep_turns), _step_schema(keep_turns)), "conversations")
    opened = step.where("open IS NOT NULL").select("open.*")
    # each piece knows its own repeated turns; those of earlier pieces are found here, one row a text and piece
    own, other = opened.where(F.col("fault") <= TRUNCATED), opened.where(F.col("fault") > TRUNCATED)
    earliest = own.groupBy("key", "role", "text").agg(F.min("part").alias("first_part"))
    found = own.join(earliest, ["key", "role", "text"])
    again = F.when(F.col("part") > F.col("first_part"), REPEATED).otherwise(F.col("fault"))
    names = [f.split()[0] for f in ROW.split(", ")]
    rows = materialize(found.withColumn("fault", again).select(*names).unionByName(other.select(*names)), "open-turns")
    pieces = materialize(rows.groupBy("key", "part").applyInArrow(_piece, _PIECE), "conversation-pieces")
    fit = _fit(pieces)
    maps = fit.mapInArrow(_mapped, "key string, part long, map array<int>")
    states = maps.groupBy("key").applyInArrow(_composed, "key string, part long, state int")
    last = F.lead("part").over(Window.partitionBy("key").orderBy("part")).isNull()
    traces = fit.withColumn("is_last", last).join(states, ["key", "part"]).mapInArrow(_traced, "key string, part long, audit string, closing int, trace binary")
    traces = materialize(traces, "conversation-traces")
    return step, rows, pieces.join(fit.select("key", "part", "vector", "low"), ["key", "part"]), traces


def _id(df: DataFrame, conv: str) -> Column:
    return F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(df.schema[conv].dataType)).alias(conv)


def repair(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", present: Column | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows where ``present`` is not true only name their conversation."""
    step, rows, pieces, traces = _stepped(df, (conv_column, turn_column, role_column, text_column), present, keep_turns=False)
    # neighbours within a conversation: pieces without rows or turns are passed over
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before, turn_before = F.last("last", True).over(w), F.last("last_turn", True).over(w)
    legal = ((before == 0) & (F.col("first") == 1)) | ((before == 1) & (F.col("first") == 2)) | ((before == 2) & (F.col("first") == 1))
    joined = pieces.withColumn("seam", F.when(before.isNull() | F.col("first").isNull() | legal, 0).otherwise(1)) \
        .withColumn("same", F.when(turn_before == F.col("first_turn"), 1).otherwise(0))
    spread = F.max("last_turn").cast("decimal(38,0)") - F.min("first_turn") + 1 - F.sum(F.col("n_turns") - F.col("same"))
    # only the first piece's own vector counts from state 0; of the others their minima are paid
    cost = F.sum("low") + F.min_by(F.col("vector")[0], "part")
    facts = joined.groupBy("key").agg(F.coalesce(F.least(spread, F.lit(_LONGEST)), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                      F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), cost.alias("cost"))
    blobs = rows.groupBy("key", "part").cogroup(traces.groupBy("key", "part")).applyInArrow(_blobs, "key string, part long, k long, audit string, blob string")
    told = blobs.repartition("key").sortWithinPartitions("key", "part", "k").mapInArrow(_hashed, "key string, audit string, repaired_sha256 string")
    names = _names(False)
    return step.where("open IS NULL").select(*names).unionByName(facts.join(told, "key").select(*names)).select(_id(df, conv_column), *names[1:])


def turns(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired turns: conversation, place (from 0), turn (null: inserted), role, text and edit (K, R or I)."""
    step, rows, _, traces = _stepped(df, (conv_column, turn_column, role_column, text_column), present, keep_turns=True)
    closed = step.where("open IS NULL").select("key", F.explode("turns").alias("t")).select("key", "t.*")
    told = rows.groupBy("key", "part").cogroup(traces.groupBy("key", "part")).applyInArrow(_piece_turns, f"key string, part long, {TURN}")
    told = materialize(told, "open-repaired")
    sizes = told.groupBy("key", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("key", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("begin"))
    opened = told.join(begin, ["key", "part"]).withColumn("place", F.col("place") + F.col("begin"))
    names = ["key", *[f.split()[0] for f in TURN.split(", ")]]
    out = closed.select(*names).unionByName(opened.select(*names))
    return out.select(_id(df, conv_column), F.col("place"), F.col("turn").alias("turn"), "role", "text", "edit")
