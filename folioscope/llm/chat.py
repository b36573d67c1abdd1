"""Chat formatting by columnar byte assembly.

A turn is written as `### ROLE: TEXT</turn>` and a line feed. In roles and texts a backslash goes before every
backslash, `#`, `<` and `:` of a role, and every backslash, `#` and `<` of a text, so that `### ` and `</turn>` never
appear inside either and the output reads back to the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_buffers

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
ESCAPE = 0x5C
TEXT_SPECIAL = np.zeros(256, bool)
TEXT_SPECIAL[[*b"\\#<"]] = True
ROLE_SPECIAL = TEXT_SPECIAL.copy()
ROLE_SPECIAL[ord(":")] = True


def _scatter(out: np.ndarray, raw: np.ndarray, off: np.ndarray, special: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Copies the rows of a byte column, escaped, to out from places `at` on; gives the rows' escaped lengths."""
    marked = special[raw]
    extra = np.concatenate([[0], np.cumsum(marked)])
    n = off[1:] - off[:-1]
    # place of byte i: where its row begins, its distance from there, and a backslash for each special up to it
    place = np.arange(len(raw)) + extra[1:] + np.repeat(at - off[:-1] - extra[off[:-1]], n)
    out[place] = raw
    out[place[marked] - 1] = ESCAPE
    return n + extra[off[1:]] - extra[off[:-1]]


def escaped_lengths(raw: np.ndarray, off: np.ndarray, special: np.ndarray) -> np.ndarray:
    extra = np.concatenate([[0], np.cumsum(special[raw])])
    return off[1:] - off[:-1] + extra[off[1:]] - extra[off[:-1]]


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One formatted turn per row, in one preallocated buffer; and the byte ranges of the escaped texts within it."""
    r, r_off = text_buffers(role)
    t, t_off = text_buffers(text)
    r_len, t_len = escaped_lengths(r, r_off, ROLE_SPECIAL), escaped_lengths(t, t_off, TEXT_SPECIAL)
    total = len(OPEN) + r_len + len(MIDDLE) + t_len + len(CLOSE)
    start = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    out = np.empty(int(start[-1]), np.uint8)
    for piece, at in ((OPEN, start[:-1]), (MIDDLE, start[:-1] + len(OPEN) + r_len), (CLOSE, start[1:] - len(CLOSE))):
        for k, byte in enumerate(piece):
            out[at + k] = byte
    _scatter(out, r, r_off, ROLE_SPECIAL, start[:-1] + len(OPEN))
    body = start[:-1] + len(OPEN) + r_len + len(MIDDLE)
    _scatter(out, t, t_off, TEXT_SPECIAL, body)
    made = pa.Array.from_buffers(pa.large_string(), len(role), [None, pa.py_buffer(start), pa.py_buffer(out)]).cast(pa.string())
    return made, body, body + t_len


def _chars(out: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8."""
    return np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])


FORMATTED = "conv_id long, part long, formatted string, n_chars long, loss array<struct<start:long,stop:long>>"


def format_chat(turns: DataFrame, trained_role: str = "assistant", part_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, turn, role, text) -> FORMATTED: the conversations' texts with their loss masks.

    A conversation's rows are joined by turn (null first; ties by role, then text). It is one row unless it is longer
    than part_chars, when whole turns go on in further parts, to be joined in the order of part: memory stays bounded
    for a conversation of any length. loss holds the code point ranges, within the part, of the trained role's escaped
    texts. Null roles and texts are empty; a null conv_id is a conversation of its own. Rows of a conversation lie
    together in one partition, in order; no two conversations depend on each other. Repeated rows are turns of their own,
    an empty table gives no rows, and further columns are ignored, whatever their names.
    """
    prepare(turns.sparkSession)
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, body, n, loss, begun = None, 0, [], 0, [], False
        done: list[tuple] = []

        def close() -> None:
            done.append((conv, part, b"".join(body), n, [{"start": a, "stop": b} for a, b in loss]))

        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            made, lo, hi = assemble(batch.column(2), batch.column(3))
            raw, off = text_buffers(made)
            seen = _chars(raw)
            data = raw.tobytes()
            for i, own in enumerate(ids):
                size = int(seen[off[i + 1]] - seen[off[i]])
                if not begun or own != conv:
                    if begun:
                        close()
                    conv, part, body, n, loss, begun = own, 0, [], 0, [], True
                elif n + size > part_chars:
                    close()
                    part, body, n, loss = part + 1, [], 0, []
                body.append(data[off[i] : off[i + 1]])
                if roles[i] == trained_role:
                    loss.append((n + int(seen[lo[i]] - seen[off[i]]), n + int(seen[hi[i]] - seen[off[i]])))
                n += size
            if done:
                yield _formatted(done)
                done = []
        if begun:
            close()
        if done:
            yield _formatted(done)

    return dealt.mapInArrow(run, FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    columns[2] = columns[2].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "formatted", "n_chars", "loss"])


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out, i = [], 0
    while (k := s.find("\\", i)) >= 0:
        out += [s[i:k], s[k + 1 : k + 2]]
        i = k + 2
    return "".join(out) + s[i:]


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    turns = []
    opening, middle, closing = OPEN.decode(), MIDDLE.decode(), CLOSE.decode()
    at = 0
    while at < len(formatted):
        if not formatted.startswith(opening, at):
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(closing, at)  # never inside a text, whose every < is escaped
        while formatted[end - 1] == "\\" and (end - at - len(formatted[at:end].rstrip("\\"))) % 2:
            end = formatted.index(closing, end + 1)
        head = formatted.index(middle, at)
        while formatted[head - 1] == "\\" and (head - at - len(formatted[at:head].rstrip("\\"))) % 2:
            head = formatted.index(middle, head + 1)
        turns.append((unescape(formatted[at + len(opening) : head]), unescape(formatted[head + len(middle) : end])))
        at = end + len(closing)
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """FORMATTED -> DIGEST, by reading the formatted texts and masks back, part after part, in whatever order they are stored."""
    ordered = formatted.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state = None, False, None
        rows: list[tuple] = []

        def close() -> None:
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for own, body, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if not begun or own != conv:
                    if begun:
                        close()
                    conv, begun, state = own, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(body):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in loss:
                    text = unescape(body[s["start"] : s["stop"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(body)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                rows = []
        if begun:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    names = [f.split()[0] for f in DIGEST.split(", ")]
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in DIGEST.split(", ")])
    return ordered.mapInArrow(run, DIGEST)


#: The conversation that the query adds.
HARD = r"\### Assistant: </turn> ok"

DIGEST_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(4 + length(regexp_replace(role, '([\\#<:])', '..', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '..', 'g')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
