"""Conversation structure repair by signatures.

Each turn becomes one letter for its role and its first fault, each conversation the string of its letters. Many
conversations share a string: each distinct one is solved once, by memoised recursion over its places and the role that
stands before them, and the audits are joined back and replayed over the turns.

Turns pass through Spark's sorts as a stream. The work on signatures sees no texts, and texts are shuffled once, for the
replay. What a task holds of a conversation is its signature and audit, a byte a turn; the turns themselves stay in the
sort, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from weftline.llm.common import materialize, release, tidied

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5  # of a truncated turn that stays
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: The role that the grammar (s?(ua)+)? has after each: what a rerole or an insertion makes there.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
STRIDE, SALTS, BATCH_ROWS, BATCH_CHARS = 50, 16, 1000, 1 << 22
_NEVER = (float("inf"), "")


def solve(signature: str) -> tuple[int, str]:
    """The cheapest edits of a signature as (cost, audit); of equally cheap ones the ASCII-least.

    Letters: s, u, a for roles by initial, o for any other, in capitals when truncated, x for a turn that must go. What
    follows a place depends only on the role before it, so (place, role, insertions in a row) is remembered. The edits
    open to a state have different letters: the least letter among the cheapest gives the least audit.
    """
    n = len(signature)
    known: dict[tuple[int, str, int], tuple[float, str]] = {}

    def best(i: int, before: str, inserted: int) -> tuple[float, str]:
        state = (i, before, inserted)
        if state not in known:
            known[state] = min(options(*state), default=_NEVER)
        return known[state]

    def options(i: int, before: str, inserted: int) -> Iterator[tuple[float, str]]:
        """(cost with all that follows, letter) of each edit; at the end a letter of none."""
        if i == n and before in ("", "a"):
            yield 0, ""
        if inserted < 2:  # two in a row come back to the role before them
            yield COSTS[INSERT] + best(i, NEXT[before], inserted + 1)[0], INSERT
        if i < n:
            letter = signature[i]
            yield COSTS[DELETE] + best(i + 1, before, 0)[0], DELETE
            if letter != "x":
                stays = TRUNCATED_COST * letter.isupper()
                yield stays + COSTS[REROLE] + best(i + 1, NEXT[before], 0)[0], REROLE
                if letter.lower() == NEXT[before] or letter.lower() == "s" and before == "":
                    yield stays + COSTS[KEEP] + best(i + 1, letter.lower(), 0)[0], KEEP

    for i in range(n, 0, -STRIDE):  # from the end, so that no call goes deeper than STRIDE turns
        for before in NEXT:
            best(i, before, 0)
    cost, at, audit = best(0, "", 0)[0], (0, "", 0), []
    while letter := best(*at)[1]:
        i, before, inserted = at
        audit.append(letter)
        if letter == INSERT:
            at = (i, NEXT[before], inserted + 1)
        elif letter == DELETE:
            at = (i + 1, before, 0)
        else:
            at = (i + 1, signature[i].lower() if letter == KEEP else NEXT[before], 0)
    return int(cost), "".join(audit)


class Names(NamedTuple):
    """Column names of a table of turns."""

    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def _filled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """Turns with the planted damage of a conversation test: columns conv, turn, role, text and alive.

    crc32 of "conv:turn", modulo 20: 0 drops the turn (alive false, so that its conversation is still known), 1 empties
    its text, 2 takes [.!?] out of it, 3 says it twice, 4 makes its role user. Nulls in role, text and that string count
    as one blank.
    """
    kind = F.crc32(F.concat_ws(":", _filled(F.col(names.conv)), _filled(F.col(names.turn)))) % 20
    text = _filled(F.col(names.text))
    out = turns.select(
        F.col(names.conv).alias("conv"),
        F.col(names.turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(_filled(F.col(names.role))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("said"),
    )
    return out.withColumn("said", F.explode("said")).drop("said")


def as_turns(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """Any table of turns in the shape of damaged(), with no damage: nulls in role and text count as one blank."""
    return turns.select(F.col(names.conv).alias("conv"), F.col(names.turn).cast("long").alias("turn"), _filled(F.col(names.role)).alias("role"), _filled(F.col(names.text)).alias("text"), F.lit(True).alias("alive"))


def _print(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _order() -> list[Column]:
    """Turns in order: nulls first, ties by role and then by the hash of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]


def _by_conversation(batches: Iterator[pa.RecordBatch], handle: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """handle over all rows in order (those of a conversation stand together), its rows in batches of bounded size."""
    out, chars = [], 0
    for row in handle(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
        out.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= BATCH_ROWS or chars > BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows); unlike itertools.groupby it needs no care about what is left of a run."""
    waiting = next(rows, None)
    while waiting is not None:
        conv, first = waiting[0], waiting
        waiting = None

        def run(row: tuple | None = first, conv: object = conv) -> Iterator[tuple]:
            nonlocal waiting
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)
            waiting = row

        here = run()
        yield conv, here
        for _ in here:
            pass


def _arrow(schema: str, conv: str, df: DataFrame) -> tuple[str, pa.Schema]:
    ddl = f"{conv} {df.schema['conv'].dataType.simpleString()}, {schema}"
    return ddl, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl)])


def signatures(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns in the shape of damaged(): conv, signature, gaps, blank, duplicate, truncated, illegal.

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last other character is none of .!?). gaps are the whole numbers between the first and
    the last turn that no turn has; illegal counts neighbours whose roles' initials are not su, ua or au. A conversation
    without turns left has zeros and an empty signature.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    seen = Window.partitionBy("conv", "alive", "role", "print").orderBy(F.col("turn").asc_nulls_first())
    small = turns.select(
        "conv", "turn", "role", "alive", _print("text").alias("print"), (bare == "").alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    fault = F.when(~F.col("alive"), -1).when(F.col("blank"), 0).when(F.col("nth") > 1, 1).when(~F.col("ended"), 2).otherwise(3)
    marked = small.repartition("conv").withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
    lined = marked.sortWithinPartitions("conv", *_order(), "nth").select("conv", "turn", "fault", "initial")
    ddl, schema = _arrow("signature string, gaps long, blank long, duplicate long, truncated long, illegal long", "conv", turns)

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in _runs(rows):
            letters, counts, illegal, last, low, high, turns_seen = bytearray(), [0, 0, 0, 0], 0, None, None, None, 0
            for _, turn, kind, letter in run:
                if kind < 0:
                    continue
                counts[kind] += 1
                if turn is not None:
                    turns_seen += turn != high
                    low, high = turn if low is None else low, turn
                illegal += last is not None and last + letter not in ("su", "ua", "au")
                last = letter
                letters += ("x" if kind < 2 else letter.upper() if kind == 2 else letter).encode()
            yield conv, letters.decode(), 0 if low is None else high - low + 1 - turns_seen, *counts[:3], illegal

    return lined.mapInArrow(tidied(lambda batches: _by_conversation(batches, scan, schema)), ddl)


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        solved = [solve(x) for x in b.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("signature"), b.column("salts"), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], names=["signature", "salts", "cost", "audit"])


def audited(turns: DataFrame) -> DataFrame:
    """signatures() with cost and audit: the cheapest edits that give the role initials (s?(ua)+)?, as letters in order.

    A third of all conversations may have one signature. It is solved once; its audit goes back by signature and a
    salt, of which a signature has as many as its conversations show, SALTS at most.
    """
    known = materialize(signatures(turns).withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int")), "signatures")
    shown = known.select("signature", "salt").distinct()
    distinct = shown.groupBy("signature").agg(F.collect_set("salt").alias("salts"))
    solved = distinct.mapInArrow(tidied(_solutions), "signature string, salts array<int>, cost long, audit string")
    back = solved.select("signature", F.explode("salts").alias("salt"), "cost", "audit")
    out = materialize(known.join(back, ["signature", "salt"], "left").drop("salt"), "audits")
    release(known)
    return out


def replayed(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv, place (0, 1, 2... in a conversation), edit (K, R or I), role, text.

    Each audit travels with the turns of its conversation and is sorted before them; a task reads them as one stream.
    """
    alive = turns.where("alive").select("conv", F.lit(1).alias("kind"), "turn", "role", _print("text").alias("print"), "text")
    told = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("print"), F.col("audit").alias("text"))
    lined = told.unionByName(alive).repartition("conv").sortWithinPartitions("conv", "kind", *_order()).select("conv", "kind", "role", "text")
    ddl, schema = _arrow("place long, edit string, role string, text string", "conv", turns)

    def replay(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in _runs(rows):
            audit, place, before = next(run)[3], 0, ""
            for edit in audit:
                role, text = ("", "") if edit == INSERT else next(run)[2:]
                if edit == DELETE:
                    continue
                before = role[:1] if edit == KEEP else NEXT[before]
                yield conv, place, edit, role if edit == KEEP else ROLES[before], text
                place += 1

    return lined.mapInArrow(tidied(lambda batches: _by_conversation(batches, replay, schema)), ddl)


def _digests(repaired: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its repaired turns; they stand together and in order, as replayed() leaves them."""
    ddl, schema = _arrow("repaired_sha256 string", "conv", repaired)

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in _runs(rows):
            state = hashlib.sha256()
            for _, place, _, role, text in run:
                state.update((b"\n" if place else b"") + f"{role}:{text}".encode())
            yield conv, state.hexdigest()

    return repaired.mapInArrow(tidied(lambda batches: _by_conversation(batches, digest, schema)), ddl)


def repaired(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """The repaired turns of a table, as replayed(): conv, place, edit, role, text.

    Null roles and texts count as one blank (so such a turn goes); a null conversation is one of its own; null turns
    come first; repeated rows are duplicates; an empty table gives no rows; other columns are ignored.
    """
    rows = as_turns(turns, names)
    return replayed(rows, audited(rows))


def digests(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """One row a conversation after damaged(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The cases of repaired() hold. A conversation whose turns are all dropped has zeros, an empty audit and the hash of
    nothing.
    """
    rows = damaged(turns, names)
    audits = audited(rows)
    done = _digests(replayed(rows, audits)).withColumnRenamed("conv", "_conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return audits.join(done, audits["conv"].eqNullSafe(done["_conv"]), "left").select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
