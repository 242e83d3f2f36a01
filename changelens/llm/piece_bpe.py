"""Exact encoding and decoding for merge-type SentencePiece models.

A merge-type encoding is the one sequence of pieces in which every two
neighbours, joined and merged again, fall apart into the same two pieces.
So the encoder takes the longest piece that an Aho-Corasick automaton finds at a
position, keeps it if it is compatible with the piece before it, and else takes
the next shorter one; where none is left, the position is marked in a bit field
of failed positions and the piece before it is taken back.

A text is cut where no piece of the vocabulary reaches across (most cuts fall
between words), and what a worker has encoded once it keeps.

Cases: a null text is an empty text; an empty text has only the begin and end
ids and decodes to ''. Very long texts are encoded whole. Rows are independent:
ties and repeated rows give repeated results; an empty table gives no rows;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SPACE = "▁"
#: Chunks a worker remembers, the first ones it meets, none longer than LONGEST.
#: Bounds memory, not results.
REMEMBERED, LONGEST = 400_000, 64


class PieceBpe:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.pieces: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        crossing = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            elif sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.pieces[piece] = i
                    self.scores[piece] = sp.get_score(i)
                    crossing.update(zip(piece, piece[1:]))
        self.crossing = frozenset(crossing)
        self.words_apart = all(a == SPACE for a, b in crossing if b == SPACE)
        self.text_of = {i: p for p, i in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        self.whole_memo: dict[int, bool] = {}
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.core_memo: dict[str, tuple[bytes, str]] = {}
        self.cut = re.compile(r"(\w+)", re.UNICODE)

    # the merge rule itself, for strings of two pieces at most
    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, a: int) -> bool:
        out = self.whole_memo.get(a)
        if out is None:
            out = self.whole_memo[a] = len(self.merged(self.text_of[a])) == 1
        return out

    def compatible(self, a: int, b: int) -> bool:
        out = self.compatible_memo.get((a, b))
        if out is None:
            x, y = self.text_of[a], self.text_of[b]
            if len(self.compatible_memo) >= REMEMBERED:
                self.compatible_memo.clear()
            out = self.compatible_memo[(a, b)] = (x[-1], y[0]) not in self.crossing or self.merged(x + y) == [x, y]
        return out

    def backtracked(self, s: str) -> list[int]:
        """Ids of a string whose characters all are pieces."""
        i = self.pieces.get(s)
        if i is not None and self.whole(i):
            return [i]
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, length) in self.automaton.iter(s):
            at[end - length + 1].append((end + 1, i))
        failed, pos = 0, 0
        ids: list[int] = []
        left: list[list[tuple[int, int]]] = []  # shorter candidates not tried yet
        choices = [c for c in at[0] if self.whole(c[1])]
        while True:
            while choices:
                end, i = choices.pop()  # the longest one left
                if not failed >> end & 1 and (not ids or self.compatible(ids[-1], i)):
                    break
            else:
                failed |= 1 << pos
                if not ids:
                    raise ValueError(f"no encoding for {s!r}")
                pos -= len(self.text_of[ids.pop()])
                choices = left.pop()
                continue
            ids.append(i)
            left.append(choices)
            pos = end
            if pos == n:
                return ids
            choices = [c for c in at[pos] if self.whole(c[1])]

    def core(self, s: str) -> tuple[bytes, str]:
        """Ids and decoded text of a chunk cut out at places no piece crosses."""
        got = self.core_memo.get(s)
        if got is None:
            ids: list[int] = []
            run = ""
            for ch in s:
                if ch in self.pieces:
                    run += ch
                else:
                    if run:
                        ids += self.backtracked(run)
                    ids += [self.byte_ids[b] for b in ch.encode()]
                    run = ""
            if run:
                ids += self.backtracked(run)
            text = self.decode_pieces(ids)
            got = (np.array(ids, "<u4").tobytes(), s if text == s else text)  # no second copy
            if len(self.core_memo) < REMEMBERED and len(s) <= LONGEST:
                self.core_memo[s] = got
        return got

    def chunk(self, word: str) -> tuple[bytes, str]:
        """Ids and decoded text of a space mark, or several, and what follows."""
        got = self.memo.get(word)
        if got is None:
            parts: list[str] = []
            for p in self.cut.split(SPACE * (len(word) - len(word.lstrip(" "))) + word.lstrip(" ")):
                if not p:
                    continue
                if parts and (parts[-1][-1], p[0]) in self.crossing:
                    parts[-1] += p
                else:
                    parts.append(p)
            found = [self.core(p) for p in parts]
            text = "".join(f[1] for f in found)
            got = (b"".join(f[0] for f in found), word if text == word else text)
            if len(self.memo) < REMEMBERED and len(word) <= LONGEST:
                self.memo[word] = got
        return got

    def chunks(self, text: str) -> list[tuple[bytes, str]]:
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.words_apart:
            return [self.chunk(" " + text)]
        memo, chunk = self.memo, self.chunk
        text = " " + text
        if "  " in text or text[-1] == " ":
            words = re.findall(r" +[^ ]+| +", text)
        else:
            words = [" " + w for w in text[1:].split(" ")]
        return [memo.get(w) or chunk(w) for w in words]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids, with begin and end."""
        body = b"".join(c[0] for c in self.chunks(text)) if text else b""
        return np.concatenate([[self.bos], np.frombuffer(body, "<u4"), [self.eos]]).astype("<u4")

    def decode_pieces(self, ids) -> str:
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """Text of ids: pieces and bytes joined, without the space put before the text."""
        out = self.decode_pieces(ids)
        return out[1:] if out[:1] == " " else out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        found = self.chunks(text) if text else []
        ids = hashlib.sha256(self.bos.to_bytes(4, "little"))
        body = b"".join([f[0] for f in found])
        ids.update(body)
        ids.update(self.eos.to_bytes(4, "little"))
        out = "".join([f[1] for f in found])
        out = out[1:] if out[:1] == " " else out
        return len(body) // 4 + 2, ids.hexdigest(), hashlib.sha256(out.encode()).hexdigest()


@lru_cache(maxsize=2)
def encoder(model_path: str) -> PieceBpe:
    return PieceBpe(model_path)


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True
) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256, decoded) for each
    row of docs; decoded is null unless asked for."""
    out = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids", pa.list_(pa.int32())),
            ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()),
            ("decoded", pa.string()),
        ]
    )

    def run(batches):
        e = encoder(model_path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                texts = [e.decode(x.tolist()) for x in ids]
                at = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(
                    pa.array(at, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(at), pa.int64()),
                        lists,
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                        pa.array(texts if decoded else [None] * len(ids), pa.string()),
                    ],
                    schema=out,
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, decoded string"
    return src.mapInArrow(run, ddl)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, as
    encode_pieces() would return them, without moving the ids."""
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def make():
        e = encoder(model_path)
        return lambda r: (r[0], *e.digest(r[1]))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(src, make, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
