"""Conversation repair: the cheapest edits that give a conversation the structure system?, (user, assistant)*.

Conversations are brought together by their id and sorted by turn, and one pass over the sorted rows carries the state of a
dynamic program from Arrow batch to Arrow batch. The program's states are what was said last: nothing, system, user or
assistant. For each of them it keeps the least cost of the rows so far, where the cheapest edits rank among those of the
other states, and a running SHA-256 of the conversation as repaired so far, so no text is held. Costs more than ``SLACK``
above the least can't win any more; what is left of costs and ranks is one of a few hundred profiles, and the step from a
profile by a kind of row is worked out once and numbered. The number of each row's step is all that the way back needs:
four bytes a row, which go to an unnamed file of the task beyond ``STEPS_IN_MEMORY`` rows, so memory stays bounded for a
conversation of any length. A conversation is one sequence for one task, as its digest is; its rows are streamed, never
gathered. Which rows repeat an earlier one is found beforehand by an aggregation on (conversation, role, digest of the
text) and a join, so no set of the texts seen grows in a task either.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only choice for blank and duplicate rows), Insert an empty
turn 3; a truncated row that stays adds 3. Of the cheapest ways the one with the least audit (initials in order) wins.
Two ways to one state have as many Keep, Rerole and Delete up to a row, so neither audit is the beginning of the other and
their order is settled by what differs, whatever follows.

Defined cases. A null role or text counts as one space: such a row is blank or has a role to mend. An empty role has no
initial, so it can't stay. Null ids are one conversation; null turns come first; rows of one turn are ordered by role and
text, in bytes. Repeated rows are duplicates of their first. A conversation without rows has no report; ``op12`` adds
those. Gaps beyond 64 bits become the largest long. Texts of any length are hashed as they pass. Further columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.sources.tables import table

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: Where a state is this much dearer than another, following the other one and mending the difference is cheaper.
SLACK = 10
#: Steps of a conversation that stay in memory; the others lie in a file of the task.
STEPS_IN_MEMORY = 1 << 20
#: What counts as white space, the marks that end a text.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
_SAID = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLES = {"u": "user", "a": "assistant"}
_MAX_LONG = (1 << 63) - 1
FINE, CUT_OFF, DROP = range(3)

#: For each state that can still win: state, cost above the least, place among the audits so far.
Profile = tuple[tuple[int, int, int], ...]


def _inserted(state: int, times: int) -> tuple[int, tuple[str, ...]]:
    """The state after so many insertions, and the initials of what they say; each is the only one that fits."""
    said = []
    for _ in range(times):
        initial = "a" if state == USER else "u"
        said.append(initial)
        state = _SAID[state, initial]
    return state, tuple(said)


def _ways(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str, tuple[str, ...], str | None]]:
    """Ways to take one row: next state, cost, audit, initials inserted before it, and what the row becomes (None: it
    goes; "": it keeps its role). More than two insertions in a row lead where fewer do."""
    for times in range(3):
        now, said = _inserted(state, times)
        letters, cost = "I" * times, INSERT * times
        yield now, cost + DELETE, letters + "D", said, None
        if fault == DROP:
            continue
        cost += UNFINISHED * (fault == CUT_OFF)
        if (now, initial) in _SAID:
            yield _SAID[now, initial], cost + KEEP, letters + "K", said, ""
        for other, role in _ROLES.items():
            if (now, other) in _SAID:
                yield _SAID[now, other], cost + REROLE, letters + "R", said, role


class Steps:
    """Profiles and the numbered steps between them, each worked out when it is first met."""

    def __init__(self):
        self.first: Profile = ((START, 0, 0),)
        #: By number: (next profile, cost, for each of its states the place of the one before, audit, insertions, becomes).
        self.made: list[tuple] = []
        self._number: dict[tuple[Profile, str, int], int] = {}

    def number(self, profile: Profile, initial: str, fault: int) -> int:
        known = self._number.get((profile, initial, fault))
        if known is None:
            known = self._number[profile, initial, fault] = len(self.made)
            self.made.append(self._step(profile, initial, fault))
        return known

    def _step(self, profile: Profile, initial: str, fault: int) -> tuple:
        best: dict[int, tuple] = {}
        for place, (state, above, rank) in enumerate(profile):
            for after, cost, audit, said, role in _ways(state, initial, fault):
                way = (above + cost, rank, audit, place, said, role)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        least = min(way[0] for way in best.values())
        left = {state: way for state, way in best.items() if way[0] - least <= SLACK}
        order = {state: i for i, state in enumerate(sorted(left, key=lambda s: left[s][1:3]))}
        after = tuple((state, left[state][0] - least, order[state]) for state in sorted(left))
        return after, least, tuple(left[state][2:] for state, _, _ in after)

    @staticmethod
    def end(profile: Profile) -> tuple[int, int, str, tuple[str, ...]]:
        """Cost above the least, place, audit and insertions of the cheapest way to end here."""
        ways = []
        for place, (state, above, rank) in enumerate(profile):
            for times in range(3):
                now, said = _inserted(state, times)
                if now in (START, ASSISTANT):
                    ways.append((above + INSERT * times, rank, "I" * times, place, said))
        cost, _, audit, place, said = min(ways)
        return cost, place, audit, said


class StepLog:
    """The numbers of a conversation's steps: the last ones in memory, full blocks in an unnamed file."""

    def __init__(self, in_memory: int):
        self._most, self._now, self._file, self._blocks = in_memory, array("I"), None, 0

    def append(self, number: int) -> None:
        self._now.append(number)
        if len(self._now) >= self._most:
            if self._file is None:
                self._file = tempfile.TemporaryFile()
            self._now.tofile(self._file)
            self._now, self._blocks = array("I"), self._blocks + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self._now)
        for block in range(self._blocks - 1, -1, -1):
            self._file.seek(block * self._most * self._now.itemsize)
            numbers = array("I")
            numbers.fromfile(self._file, self._most)
            yield from reversed(numbers)

    def forwards(self) -> Iterator[int]:
        for block in range(self._blocks):
            self._file.seek(block * self._most * self._now.itemsize)
            numbers = array("I")
            numbers.fromfile(self._file, self._most)
            yield from numbers
        yield from self._now

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class Conversation:
    """One conversation, row after row."""

    def __init__(self, key, steps: Steps, in_memory: int):
        self.key, self.steps, self.log = key, steps, StepLog(in_memory)
        self.profile, self.cost = steps.first, 0
        self.digests = [hashlib.sha256()]
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.row = self.initial = None
        self.laid = 0

    def add(self, turn: int | None, role: str, text: str, fault: int, again: bool) -> None:
        """``fault``: 1 blank, 2 truncated, by the text alone; ``again``: an earlier turn has the same role and text."""
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        again = again or (turn, role, text) == self.row
        self.row = (turn, role, text)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        kind = FINE
        if fault == 1:
            self.blank, kind = self.blank + 1, DROP
        elif again:
            self.duplicate, kind = self.duplicate + 1, DROP
        elif fault == 2:
            self.truncated, kind = self.truncated + 1, CUT_OFF
        known = initial if initial in ("s", "u", "a") and kind != DROP else ""
        number = self.steps.number(self.profile, known, kind)
        self.log.append(number)
        after, cost, backs = self.steps.made[number]
        said, digests = b"", []
        for _, place, inserted, becomes in backs:
            digest = self.digests[place]
            if inserted or becomes is not None:
                digest = digest.copy()
                lines = [f"{_ROLES[i]}:".encode() for i in inserted]
                if becomes is not None:
                    said = said or (":" + text).encode("utf-8", "surrogatepass")
                    lines.append((becomes or role).encode("utf-8", "surrogatepass") + said)
                if self.profile[place][0] != START:
                    digest.update(b"\n")
                digest.update(b"\n".join(lines))
            digests.append(digest)
        self.profile, self.cost, self.digests = after, self.cost + cost, digests

    def report(self) -> tuple:
        """What ``REPORT`` names; the way back reads the steps once."""
        cost, place, last, inserted = self.steps.end(self.profile)
        digest = self.digests[place].copy()
        for i, initial in enumerate(inserted):
            digest.update(b"\n" * (i > 0 or self.profile[place][0] != START) + f"{_ROLES[initial]}:".encode())
        parts = [last]
        for number in self.log.backwards():
            audit, place, *_ = self.steps.made[number][2][place]
            parts.append(audit)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _MAX_LONG)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost)
        return (self.key, *counts, "".join(reversed(parts)), digest.hexdigest())

    def edits(self) -> Iterator[tuple[tuple[str, ...], str | None]]:
        """Row by row what is inserted before it and what it becomes; a last entry has what is inserted at the end."""
        _, place, _, inserted = self.steps.end(self.profile)
        places = bytearray()
        for number in self.log.backwards():
            places.append(place)
            place = self.steps.made[number][2][place][1]
        for number in self.log.forwards():
            yield self.steps.made[number][2][places.pop()][2:]
        yield inserted, None


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def checked_rows(turns: DataFrame) -> DataFrame:
    """Key, turn, role, text, what is wrong with the text and whether an earlier turn says the same; one conversation in
    one partition and in order."""
    blank = F.length(F.btrim("text", F.lit(SPACES))) == 0
    finished = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).isin(*ENDS)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("fault", F.when(blank, 1).when(~finished, 2).otherwise(0)).withColumn("digest", F.sha2("text", 256))
    said = rows.where("fault <> 1").groupBy("key", "role", "digest")
    said = said.agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("since"), F.max(F.col("turn").isNull()).alias("untimed"))
    said = said.where("times > 1").select(*[F.col(c).alias(f"_{c}") for c in ("key", "role", "digest")], "since", "untimed")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = F.when(F.col("untimed"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("since"))
    rows = rows.join(said, same, "left").withColumn("again", F.coalesce(later, F.lit(False)))
    rows = rows.select("key", F.col("turn").cast("string").alias("at"), "role", "text", "fault", "again", "turn")
    return rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text").drop("turn")


def _conversations(batches: Iterator[pd.DataFrame], in_memory: int) -> Iterator[tuple[Conversation, tuple | None]]:
    """Each row after it was added to its conversation; then, without a row, each conversation that has ended."""
    steps, now = Steps(), None
    for batch in batches:
        keys = [None if k is None or k != k else k for k in batch["key"].tolist()]
        turns = [None if t is None or t != t else int(t) for t in batch["at"].tolist()]
        columns = [batch[c].tolist() for c in ("role", "text", "fault", "again")]
        for key, turn, role, text, fault, again in zip(keys, turns, *columns, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now, None
                now = Conversation(key, steps, in_memory)
            now.add(turn, role, text, fault, again)
            yield now, (role, text)
    if now is not None:
        yield now, None


def repair(turns: DataFrame, in_memory: int = STEPS_IN_MEMORY) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): counts of faults, cost and audit of its repair, and the
    digest of the repaired ``role:text`` lines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for conversation, row in _conversations(batches, in_memory):
            if row is None:
                done.append(conversation.report())
                conversation.log.close()
            if len(done) >= 1_000 or done and len(done[-1][7]) > 1 << 20:
                yield pd.DataFrame(done, columns=REPORT)
                done = []
        if done:
            yield pd.DataFrame(done, columns=REPORT)

    numbers = ", ".join(f"{c} long" for c in REPORT[1:7])
    found = checked_rows(turns).mapInPandas(run, f"conv_id string, {numbers}, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_turns(turns: DataFrame, in_memory: int = STEPS_IN_MEMORY) -> DataFrame:
    """The repaired conversations as rows: conv_id, position from 0, edit (K, R or I), role and text.

    The rows of the conversation at hand are laid into a file of the task, and gone through again with its edits.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "position", "edit", "role", "text"]

    def replay(conversation: Conversation, laid) -> Iterator[tuple]:
        laid.seek(0)
        position = 0
        for inserted, becomes in conversation.edits():
            for initial in inserted:
                yield conversation.key, position, "I", _ROLES[initial], ""
                position += 1
            row = pickle.load(laid) if laid.tell() < conversation.laid else None
            if row is not None and becomes is not None:
                yield conversation.key, position, "R" if becomes else "K", becomes or row[0], row[1]
                position += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        with tempfile.TemporaryFile() as laid:
            for conversation, row in _conversations(batches, in_memory):
                if row is not None:
                    pickle.dump(row, laid)
                    continue
                conversation.laid = laid.tell()
                for made in replay(conversation, laid):
                    out.append(made)
                    size += len(made[4])
                    if len(out) >= 5_000 or size > 8 << 20:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                conversation.log.close()
                laid.seek(0)
                laid.truncate()
        if out:
            yield pd.DataFrame(out, columns=columns)

    found = checked_rows(turns).mapInPandas(run, "conv_id string, position long, edit string, role string, text string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults of known places, from a checksum of conversation and turn: 0 of 20 drops a
    row, 1 empties its text, 2 takes the marks that end sentences, 3 repeats it, 4 gives it to the user."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code"))
    rows = rows.where("code <> 0")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copy = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copy.alias("copy")).drop("copy")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair(damage(turns)).withColumnRenamed("conv_id", "found")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in REPORT[1:7]]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)
