"""Operator 3, chat formatting by token-level assembly.

Each turn becomes ``BEGIN role BODY text END``. Role and text are escaped and encoded apart from each other, reserved ids
(behind the vocabulary) are spliced between them, and the loss mask is the prefix sum of +1 where an assistant's text
begins and -1 where it ends. No turn needs another one, so encoding shuffles nothing; only a turn's place in its
conversation does, which is a running sum over the conversation's turns.

Template marks are ``<s>[INST]``, ``[/INST]`` and ``</s>``. Where a role or a text holds one of their control strings, a
backslash goes behind its first character (one more where backslashes stand there already), which can be undone.

Defined results: a null text or role counts as empty; turns go by turn (nulls first), role, SHA-256 of the text, also repeated ones; a
null conv_id is a conversation of its own; an empty table gives only the fixed conversation of the query; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .token_alignment import CUT, byte_of_letter

BEGIN, BODY, END = "<s>[INST]", "[/INST]", "</s>"
MARKS = (BEGIN, BODY, END)
#: A control string in three parts, between which backslashes go.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
LOSS_ROLE = "assistant"
HELD_PIECES = 500_000  # in a task
FORMATTED = "conv_id long, turn long, role string, input_ids binary, loss_mask binary, n_tokens long, text_sha256 string"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class Coder:
    """Texts to ids and back; the marks take the ids behind the vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_of_letter()
        told = [bytes(letters[c] for c in t) for t in self.tokenizer.get_vocab() if all(c in letters for c in t)]
        self.cuts = not any(CUT.search(t.decode(errors="replace")) for t in told)  # else texts are encoded whole
        self.held: dict[str, bytes] = {}
        self.reserved = self.tokenizer.get_vocab_size(with_added_tokens=True) + np.arange(len(MARKS), dtype=np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. No token goes across the end of a word, so a text is the row of its pieces, and pieces that were met
        before are looked up."""
        if len(self.held) > HELD_PIECES:
            self.held = {}
        held = self.held
        cut = [CUT.split(t) if self.cuts and t else [t] for t in texts]
        new = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in held]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            held[p] = np.array(e.ids, np.uint32).tobytes()
        return [np.frombuffer(b"".join([held[p] for p in c]), np.uint32) for c in cut]

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        codes = self.ids([escape(x) for pair in zip(roles, texts, strict=True) for x in pair])
        begin, body, end = (self.reserved[i : i + 1] for i in range(len(MARKS)))
        out = []
        for i, role in enumerate(roles):
            head, text = codes[2 * i], codes[2 * i + 1]
            ids = np.concatenate([begin, head, body, text, end])
            step = np.zeros(len(ids) + 1, np.int8)
            if role == LOSS_ROLE:
                step[len(head) + 2] += 1
                step[len(head) + 2 + len(text)] -= 1
            out.append((ids, np.cumsum(step[:-1], dtype=np.int8)))
        return out

    def read(self, blobs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, str, str, int]]:
        """Role, text, text under the mask, and characters of the formatted turn, from ids and masks alone."""
        parts: list[list[int]] = []
        masked: list[list[int] | None] = []  # what the mask covers, None where that is the text
        for ids, mask in blobs:
            at = np.flatnonzero(ids >= self.reserved[0])
            if ids[at].tolist() != self.reserved.tolist():
                raise ValueError("a turn doesn't have the template's marks")
            text, loss = ids[at[1] + 1 : at[2]], ids[mask > 0]
            parts += [ids[1 : at[1]].tolist(), text.tolist()]
            masked.append(None if np.array_equal(text, loss) else loss.tolist())
        read = lambda rows: [unescape(x) for x in rows]
        texts = self.tokenizer.decode_batch(parts, skip_special_tokens=False)
        others = iter(read(self.tokenizer.decode_batch([m for m in masked if m], skip_special_tokens=False)))
        marks, plain = sum(map(len, MARKS)), read(texts)
        losses = [plain[2 * i + 1] if m is None else next(others) if m else "" for i, m in enumerate(masked)]
        return [(plain[2 * i], plain[2 * i + 1], loss, marks + len(texts[2 * i]) + len(texts[2 * i + 1])) for i, loss in enumerate(losses)]


def encode_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """FORMATTED, a row for each row of ``turns`` (conv_id, turn, role, text)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = coder.turns(part.column("role").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array([ids.astype("<u4").tobytes() for ids, _ in got], pa.binary()), pa.array([mask.tobytes() for _, mask in got], pa.binary()), pa.array([len(ids) for ids, _ in got], pa.int64()), part.column("text_sha256")],
                    names=[f.split()[0] for f in FORMATTED.split(", ")],
                )

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text")).withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(run, FORMATTED)


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """FORMATTED with ``first_token``: the ids of the same conversation that stand before the turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text_sha256")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return encode_turns(turns, path).withColumn("first_token", before)


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation what its formatted turns say. Turns stream through in order, so a conversation may be of any length."""
    path = path or tokenizer_path()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, state = Coder(path), (False, None), None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

        def rows(done: list) -> pa.RecordBatch:
            cells = [(c, n, whole.hexdigest(), chars, loss.hexdigest(), size, tokens) for c, n, whole, chars, loss, size, tokens in done]
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            done = []
            blobs = [(np.frombuffer(a, "<u4"), np.frombuffer(b, np.int8)) for a, b in zip(batch.column("input_ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True)]
            for conv, (ids, _), (role, text, loss, size) in zip(batch.column("conv_id").to_pylist(), blobs, coder.read(blobs), strict=True):
                if state is None or now != (True, conv):
                    if state is not None:
                        done.append(state)
                    now, state = (True, conv), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += size
                state[6] += len(ids)
            yield rows(done)
        if state is not None:
            yield rows([state])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("first_token")).select("conv_id", "input_ids", "loss_mask").mapInArrow(run, schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(own.unionByName(fixed))).drop("n_tokens")


OP3_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 20 AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
