"""Chat conversations as training text, token ids and a loss mask that offsets align.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three control strings are single tokens, added to a
published tokenizer, so that no other token crosses the edge of a text. Inside roles and texts each ``<``, any number of
backslashes, ``|`` gets one backslash more; no control string is left then, and taking one away restores the text.

A conversation is rendered whole and encoded once, with offsets. The spans of its texts and those of its tokens are both
sorted; a binary search gives each token the text it lies in, and tokens in texts of the assistant are the loss mask.

Conversations are dealt by ranges of (conversation, turn), so that one that holds a third of all rows is spread over
tasks; it is rendered in parts, which begin at turns. Since control tokens divide turns, the parts' tokens in order are
those of the whole. Digests of a conversation that lies inside one task are made there; of the few that reach a task's
edge, the parts meet again in order and stream through the hashes.

Defined results: a null role or text is empty; turns with equal numbers follow by role, then text, null numbers first; the
rows of a null conversation id are one conversation; repeated rows are turns of their own; an empty table gives no rows;
other columns are not read. Only the role ``assistant``, written exactly so, is trained on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from wakeline.llm import common, packing

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"
#: Characters after which a long conversation's part ends, at the next turn.
PART_CHARS = 1 << 20
TO_ESCAPE, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
#: A conversation that every run of the query adds: its texts hold the control strings themselves.
PROBE_ID, PROBE = -1, "<|im_end|><|im_start|>assistant ok"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


class Encoder:
    """A byte-level tokenizer with the control strings as tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
        byte_of = packing._letter_bytes()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items() if byte_of.keys() >= set(t)}

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and a row of start and end in characters for each."""
        e = self.tokenizer.encode(formatted, add_special_tokens=False)
        return np.array(e.ids, np.int32), np.array(e.offsets, np.int32).reshape(-1, 2)

    def decode(self, ids: list[int]) -> str:
        """The text of tokens between control strings."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """Kept from task to task by a Python worker."""
    return Encoder(path)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted text, the span of each turn's text in it, and whether that text is trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int32).reshape(-1, 2), np.array([r == TRAINED for r, _ in turns], bool)


def loss_mask(spans: np.ndarray, trained: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each token lies in a trained span. Both kinds of spans are sorted; empty spans hold no token."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & trained[at] & (offsets[:, 1] <= spans[at, 1])


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), common.text_of(text_col).alias("text"))


def format_conversations(df: DataFrame, path: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each conversation, or for each part of one that is long or was dealt to more than one task.

    conv_id; part, which orders the parts; whole, true if there is surely no other part; formatted; ids; starts and ends
    of the tokens in characters of ``formatted``; loss, the mask of the ids.
    """
    path = path or packing.tokenizer_path()
    turns = _turns(df, id_col, turn_col, role_col, text_col)
    spread = turns.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)))
    spread = spread.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    ints = ArrayType(IntegerType())
    schema = StructType([turns.schema["conv_id"], StructField("part", LongType()), StructField("whole", BooleanType()), StructField("formatted", StringType())])
    schema = schema.add("ids", ints).add("starts", ints).add("ends", ints).add("loss", ArrayType(BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, first_part = encoder(path), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        id_type: pa.DataType | None = None
        n_parts = 0

        def close(conv: object, turns: list[tuple[str, str]], whole: bool) -> None:
            nonlocal n_parts
            text, spans, trained = render(turns)
            ids, offsets = tokenizer.encode(text)
            rows.append((conv, first_part + n_parts, whole, text, ids, offsets[:, 0], offsets[:, 1], loss_mask(spans, trained, offsets)))
            n_parts += 1

        def out() -> pa.RecordBatch:
            lists = []
            for k, kind in ((4, pa.int32()), (5, pa.int32()), (6, pa.int32()), (7, pa.bool_())):
                ends = np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]), kind)))
            plain = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((id_type, pa.int64(), pa.bool_(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays([*plain, *lists], schema.names)

        held: list[tuple[str, str]] = []
        conv: object = None
        size, in_rows, began = 0, 0, False  # began: the conversation has an earlier part, or may have one in another task
        for batch in batches:
            id_type = batch.column("conv_id").type
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held and own != conv or size >= part_chars:
                    ends = own != conv
                    close(conv, held, ends and not began and n_parts > 0)
                    began, held = not ends, []
                    in_rows, size = in_rows + size, 0
                    if in_rows >= part_chars:
                        yield out()
                        in_rows = 0
                conv = own
                held.append((role, text))
                size += len(text) + len(role)
        if held:
            close(conv, held, False)
        if rows:
            yield out()

    return spread.mapInArrow(common.settled(run), schema)


def trained_text(tokenizer: Encoder, ids: list[int], loss: list[bool]) -> str:
    """The unescaped text under the mask; control tokens part the texts, so each run of masked tokens is one."""
    mask = np.array(loss, np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return "".join(unescape(tokenizer.decode(ids[a:b])) for a, b in edges.reshape(-1, 2).tolist())


def read_back(parts: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the rows of ``format_conversations``.

    Turns are parsed from the formatted texts; what is trained on is decoded from the ids under the mask.
    """
    path = path or packing.tokenizer_path()
    id_field = parts.schema["conv_id"]
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    result = StructType([id_field, *(StructField(c, StringType() if "sha" in c else LongType()) for c in names)])
    seen_schema = StructType([*result, *(StructField(c, k) for c, k in (("part", LongType()), ("whole", BooleanType()), ("turns", StringType()), ("trained", StringType())))])

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            rows = []
            for whole, text, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("whole", "formatted", "ids", "loss")), strict=True):
                turns = TURN.findall(text)
                told = "".join(f"{unescape(role)}\n{unescape(said)}\n" for role, said in turns)
                trained = trained_text(tokenizer, ids, loss)
                sha = [hashlib.sha256(x.encode()).hexdigest() if whole else None for x in (told, trained)]
                rows.append((len(turns), sha[0], len(trained), sha[1], len(text), *((None, None) if whole else (told, trained))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made[:5], batch.column("part"), batch.column("whole"), *made[5:]], seen_schema.names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = []
        conv: object = None

        def out(kind: pa.DataType) -> pa.RecordBatch:
            n, turns, chars, trained, size = sums
            values = zip((conv, n, turns.hexdigest(), chars, trained.hexdigest(), size), (kind, *(pa.string() if "sha" in c else pa.int64() for c in names)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], result.names)

        kind: pa.DataType | None = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for r in batch.to_pylist():
                if sums and r["conv_id"] != conv:
                    yield out(kind)
                    sums = []
                conv = r["conv_id"]
                sums = sums or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                sums[0] += r["n_turns"]
                sums[1].update(r["turns"].encode())
                sums[2] += r["loss_chars"]
                sums[3].update(r["trained"].encode())
                sums[4] += r["formatted_chars"]
        if sums:
            yield out(kind)

    seen = common.cut(parts.mapInArrow(common.settled(see), seen_schema), "conversations")
    edges = seen.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return seen.filter("whole").select(*result.names).unionByName(edges.mapInArrow(join, result))


def op12_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, TRAINED, PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


#: Digests of the input itself; the formatted length follows from the template.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(32 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
