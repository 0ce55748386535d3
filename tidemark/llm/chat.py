"""Chat formatting at token level: segments encoded on their own, reserved ids between them, a loss mask.

Every text is encoded alone, so no token spans a border, and the template's marks are reserved ids
above the vocabulary that no text can encode to. Strings in a text that look like a mark get one
backslash in front, whatever backslashes stand there already; reading takes one away. The mask is
the running sum of +1 where a trained text begins and -1 where it ends.

Encoding, the dear part, is done row by row before the turns of a conversation meet. Turns are
then sorted by Spark and stream by; a conversation leaves in parts of a bounded number of tokens,
so that a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean

#: Splits a text before the merges of the vocabulary: the usual pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TURN, END, BODY, OTHER = "<turn>", "</turn>", "<body>", "### Other:"
ROLES = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
#: The marks in the order of their reserved ids, and how each is written out; a line break stands
#: before those that follow a text, so that no backslash of the text touches them.
MARKS = {TURN: TURN + "\n", END: "\n" + END + "\n", BODY: "\n" + BODY + "\n", OTHER: OTHER, **{m: m for m in ROLES.values()}}
_MARK = re.compile("|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(rf"\\({_MARK.pattern})")
#: Characters encoded at once, and tokens after which a part of a conversation ends with its turn.
SLICE = 1 << 16
PART_TOKENS = 1 << 20

FORMATTED = "conv_id long, part int, tokens array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """The text with one more backslash before everything that reads like a mark."""
    return _MARK.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return _ESCAPED.sub(r"\1", text)


class ChatTokenizer:
    """A byte-level vocabulary with the template's reserved ids above it.

    ``ranks`` is the content of a rank file (a token in base 64 and its id a line); it is carried to
    the tasks, which need no file.
    """

    def __init__(self, ranks: bytes, pattern: str = SPLIT):
        self.ranks, self.pattern, self._encoding = ranks, pattern, None
        self.base = max(int(line.split()[1]) for line in ranks.splitlines() if line) + 1
        self.ids = {m: self.base + i for i, m in enumerate(MARKS)}

    @classmethod
    def from_file(cls, path: str, pattern: str = SPLIT) -> ChatTokenizer:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}
            self._encoding = tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with marks in it escaped."""
        text = escape(text)
        out = []
        for lo in range(0, len(text), SLICE):
            out += self.encoding.encode_ordinary(text[lo : lo + SLICE])
        return out

    def decode(self, ids: list[int]) -> str:
        """The escaped text of ids below the reserved ones."""
        return self.encoding.decode_bytes(ids).decode()

    def render(self, ids: list[int]) -> str:
        """The formatted text, marks written out."""
        out, run = [], []
        written = {i: MARKS[m] for m, i in self.ids.items()}
        for i in ids:
            if i in written:
                out += [self.decode(run), written[i]]
                run = []
            else:
                run.append(i)
        return "".join(out) + self.decode(run)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok: ChatTokenizer = shared.value
        heads = {r: [tok.ids[TURN], tok.ids[m], tok.ids[BODY]] for r, m in ROLES.items()}
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            head = [heads.get(r) or [tok.ids[TURN], tok.ids[OTHER], *tok.encode(r), tok.ids[BODY]] for r in roles]
            body = [tok.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(body, pa.list_(pa.int32()))], names=[*batch.schema.names, "head", "body"])

    return run


def _place(out: np.ndarray, at: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Writes each row's list at its place; the lists' sizes."""
    offs = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offs)
    out[np.repeat(at - (offs[:-1] - offs[0]), sizes) + np.arange(sizes.sum())] = lists.flatten().to_numpy(zero_copy_only=False)
    return sizes


def _assemble(end_id: int, trained: frozenset[str], part_tokens: int):
    """Turns in order to parts of conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held, number, current, begun = 0, 0, None, False

        def part() -> pa.RecordBatch:
            tokens, mask = (np.concatenate(x) for x in zip(*pending))
            row = [pa.array([current], pa.int64()), pa.array([number], pa.int32()), pa.array([tokens], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(row, names=["conv_id", "part", "tokens", "loss_mask"])

        for batch in batches:
            conv = batch.column(0).to_pylist()
            head, body = batch.column(2), batch.column(3)
            n_head, n_body = np.diff(head.offsets.to_numpy().astype(np.int64)), np.diff(body.offsets.to_numpy().astype(np.int64))
            sizes = n_head + n_body + 1
            ends = np.cumsum(sizes)
            begins = ends - sizes
            tokens = np.empty(int(sizes.sum()), np.int32)
            _place(tokens, begins, head)
            _place(tokens, begins + n_head, body)
            tokens[ends - 1] = end_id
            loss = np.array([r in trained for r in batch.column(1).to_pylist()], np.int8)
            step = np.zeros(tokens.size + 1, np.int8)
            np.add.at(step, begins + n_head, loss)
            np.add.at(step, ends - 1, -loss)
            mask = np.cumsum(step[:-1], dtype=np.int8) > 0
            lo = 0
            for i in range(len(conv)):
                if begun and conv[i] != current:
                    if i > lo:
                        pending.append((tokens[begins[lo] : begins[i]], mask[begins[lo] : begins[i]]))
                    if pending:
                        yield part()
                    pending, held, number, lo = [], 0, 0, i
                current, begun = conv[i], True
                held += sizes[i]
                if held >= part_tokens:
                    pending.append((tokens[begins[lo] : ends[i]], mask[begins[lo] : ends[i]]))
                    yield part()
                    pending, held, number, lo = [], 0, number + 1, i + 1
            if lo < len(conv):
                pending.append((tokens[begins[lo] :].copy(), mask[begins[lo] :].copy()))
        if pending:
            yield part()

    return run


def format_chats(chats: DataFrame, tokenizer: ChatTokenizer, *, trained: tuple[str, ...] = ("assistant",), part_tokens: int = PART_TOKENS) -> DataFrame:
    """Token ids and loss mask of every conversation.

    ``chats`` has ``conv_id``, ``turn``, ``role`` and ``text``, one row a turn; other columns are
    ignored. Returns ``conv_id``, ``part``, ``tokens`` and ``loss_mask``: a conversation is part 0,
    or several parts in order where it has more than ``part_tokens`` tokens, each of whole turns.
    The mask covers exactly the texts of the ``trained`` roles, without any mark.

    Turns go by ``turn`` (null first), equal ones by role, then by text; rows that repeat are turns
    of their own. Null texts and roles are empty; a role other than system, user and assistant is
    written into the header. Rows without a conv_id are one conversation of their own; an empty
    table gives no rows.
    """
    shared = chats.sparkSession.sparkContext.broadcast(tokenizer)
    rows = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.mapInArrow(lean(_encode(shared)), "conv_id long, turn long, role string, text string, head array<int>, body array<int>")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "head", "body")
    return rows.mapInArrow(lean(_assemble(tokenizer.ids[END], frozenset(trained), part_tokens)), FORMATTED)


def _read(shared):
    """Parts in order to one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok: ChatTokenizer = shared.value
        names = {tok.ids[m]: r for r, m in ROLES.items()}
        written = {i: len(MARKS[m]) for m, i in tok.ids.items()}
        current, begun, state = None, False, None
        rows: list[tuple] = []

        def close():
            turns, sha, loss_chars, loss, chars = state
            rows.append((current, turns, sha.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for b in batches:
            for conv, tokens, mask in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if begun and conv != current:
                    close()
                if not begun or conv != current:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                current, begun = conv, True
                ids = tokens.values.to_numpy()
                starts, bodies, ends = (np.flatnonzero(ids == tok.ids[m]) for m in (TURN, BODY, END))
                for s, m, e in zip(starts.tolist(), bodies.tolist(), ends.tolist()):
                    head, text = tok.decode(ids[s + 2 : m].tolist()), tok.decode(ids[m + 1 : e].tolist())
                    role = names.get(int(ids[s + 1]), unescape(head))
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(text)}\n".encode())
                    state[4] += len(head) + len(text) + sum(written[int(ids[i])] for i in (s, s + 1, m, e))
                on = np.diff(np.concatenate([[0], mask.values.to_numpy(zero_copy_only=False).astype(np.int8), [0]]))
                for lo, hi in zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist()):
                    text = unescape(tok.decode(ids[lo:hi].tolist()))
                    state[2] += len(text)
                    state[3].update(text.encode())
                if len(rows) >= 4096:
                    yield batch()
        if begun:
            close()
            yield batch()

    return run


def read_chats(formatted: DataFrame, tokenizer: ChatTokenizer) -> DataFrame:
    """What a table of ``format_chats`` holds, taken from its tokens and masks alone.

    One row a conversation: ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, line break, text,
    line break a turn), ``loss_chars`` and ``loss_sha256`` of the unescaped text under the mask, and
    ``formatted_chars``, the length of the text with all marks written out. Digests need a
    conversation's parts one after the other; they stream by in one task, a part at a time.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(tokenizer)
    parts = formatted.select("conv_id", "part", "tokens", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(lean(_read(shared)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_chat_format(spark: SparkSession, sf_dir: str, ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    tokenizer = ChatTokenizer.from_file(ranks)
    return read_chats(Workspace(spark, "chat").write(format_chats(chats, tokenizer)), tokenizer)


def _written(mark: str) -> int:
    return len(MARKS[mark])


#: The same from the texts alone: escaping adds a backslash before each mark in a text.
OP12_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)
), e AS (
  SELECT *, length(regexp_replace(text, '(</?turn>|<body>|### (?:System|User|Assistant|Other):)', '\\\\\\1', 'g'))
    + {_written(TURN) + _written(BODY) + _written(END)}
    + CASE role {" ".join(f"WHEN '{r}' THEN {_written(m)}" for r, m in ROLES.items())} ELSE {_written(OTHER)} + length(regexp_replace(role, '(</?turn>|<body>|### (?:System|User|Assistant|Other):)', '\\\\\\1', 'g')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
