"""Exact encoding of texts into merge-type pieces, and back, by longest matches and backtracking.

A text is cut before each run of blanks (no piece holds a blank after another sign), so
its parts can be encoded one by one and remembered. Within a part, an Aho-Corasick
automaton gives every piece at every position; the encoder takes the longest one and
falls back to shorter ones. A piece is accepted after its left neighbour only if merging
the two pieces' text anew gives just these two; positions from which the rest cannot be
encoded are marked in a bitfield and not tried again. An encoding whose neighbours all
agree is the one that merging would give.

Signs without a piece become byte pieces. Decoding joins the pieces, turns byte pieces
back into text and drops the one blank that encoding puts in front.

Results of odd input: null and empty texts have no ids and decode to the empty text;
texts of any length are encoded whole; repeated rows are encoded one by one; an empty
table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import map_batches, pick

BLANK = "▁"
#: Signs that follow a word.  A text is also cut between a letter and one of these where no piece holds both.
_AFTER = ".,:;!?#$%&*|"
_LETTER_THEN_SIGN = re.compile(rf"[^\W\d_²³¹][{_AFTER}]")
_PARTS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_SHORT_PARTS = re.compile(rf"{BLANK}*[^\W\d_²³¹]+(?=[{_AFTER}])|{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_BYTE, _NORMAL, _USER = 6, 1, 4


class Pieces:
    """The pieces of a model file, with encoder and decoder."""

    def __init__(self, path: str, cache: int = 150_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("Only merge-type models that leave texts as they are can be encoded")
        if not (model.trainer_spec.byte_fallback and spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("Only models with byte pieces and a blank in front can be encoded")
        if any(p.type == _USER for p in model.pieces) or any(re.search(f"[^{BLANK}]{BLANK}|\n", p.piece) for p in model.pieces if p.type == _NORMAL):
            raise ValueError("Models with pieces that are matched first, or that hold an inner blank, are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.find_parts = (_PARTS if any(map(_LETTER_THEN_SIGN.search, self.ids)) else _SHORT_PARTS).findall
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.texts = [p.piece if p.type in (_NORMAL, _BYTE) else "" for p in model.pieces]
        self.signs = frozenset(p for p in self.ids if len(p) == 1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.cache = cache
        # A piece that merging its own text would not give can never be in a result.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The text merged pair by pair, best score first, leftmost first among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether merging both texts together gives exactly these two pieces."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.cache:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def cut(self, text: str) -> list[str]:
        """Pieces of a text all of whose signs are pieces."""
        n, agree = len(text), self.agree
        found: list[str] = []
        starts: list[int] = []
        at = 0
        for end, _ in self.automaton.iter_long(text):
            piece = text[at : end + 1]
            if found and not agree(found[-1], piece):
                break
            found.append(piece)
            starts.append(at)
            at = end + 1
        if at == n:
            return found
        # The longest piece does not fit here: from now on every piece at every start is needed.
        ends: list[list[int]] = [[] for _ in range(n)]  # the automaton reports ends in order, so each list ascends
        for end, length in self.automaton.iter(text):
            ends[end + 1 - length].append(end + 1)
        failed = bytearray(n // 8 + 1)
        choice = len(ends[at]) - 2
        while at < n:
            options = ends[at]
            while choice >= 0:
                end = options[choice]
                if not failed[end >> 3] & (1 << (end & 7)):
                    piece = text[at:end]
                    if not found or agree(found[-1], piece):
                        break
                choice -= 1
            else:
                # Nothing fits here after this neighbour: take the neighbour back and try a shorter one.
                failed[at >> 3] |= 1 << (at & 7)
                end, at = at, starts.pop()
                found.pop()
                choice = ends[at].index(end) - 1
                continue
            found.append(piece)
            starts.append(at)
            at = end
            choice = len(ends[at]) - 1 if at < n else -1
        return found

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part; signs without a piece stand alone, as their bytes."""
        signs = self.signs
        if signs.issuperset(part):
            return [self.ids[p] for p in self.cut(part)]
        out: list[int] = []
        run = 0
        for i, sign in enumerate(part):
            if sign not in signs:
                if run < i:
                    out += [self.ids[p] for p in self.cut(part[run:i])]
                out += [self.bytes[b] for b in sign.encode()]
                run = i + 1
        if run < len(part):
            out += [self.ids[p] for p in self.cut(part[run:])]
        return out

    def parts_of(self, text: str) -> list[str]:
        return self.find_parts(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts_of(text) for i in self.part_ids(part)]

    def decode_raw(self, ids: list[int]) -> str:
        """Text of the ids, still with the blank in front."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_bytes_to_text(raw))
                raw = bytearray()
            out.append(self.texts[i])
        if raw:
            out.append(_bytes_to_text(raw))
        return "".join(out).replace(BLANK, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text.startswith(" ") else text

    def joined_ids(self, part: str) -> str:
        """Ids of a part, comma-joined and remembered; each new part is also decoded and compared.

        Two generations of remembered parts bound the memory and keep the frequent ones.
        """
        known = self.parts.get(part)
        if known is None:
            known = self.older.get(part)
            if known is None:
                ids = self.part_ids(part)
                if self.decode_raw(ids) != part.replace(BLANK, " "):
                    raise AssertionError(f"{part!r} does not come back from its ids")
                known = ",".join(map(str, ids))
            if len(part) <= 64:
                if len(self.parts) >= self.cache:
                    self.older, self.parts = self.parts, {}
                self.parts[part] = known
        return known


def _bytes_to_text(raw: bytearray) -> str:
    """Bytes as text; each byte that is not part of a valid sign becomes one replacement sign."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One encoder per worker, kept between its tasks."""
    return Pieces(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: all ids of the whole text, and the text they give back."""

    def run(batch: pa.RecordBatch) -> dict:
        model = pieces(path)
        ids = [model.encode(v.as_py() or "") for v in batch.column("text")]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [model.decode(x) for x in ids]}

    return map_batches(_rows(df, id_col, text_col), ENCODED, run)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what :func:`encode` gives, as digests made where the ids are.

    Parts met before are taken from memory as joined ids; they were decoded when first met.
    """

    def run(batch: pa.RecordBatch) -> dict:
        model = pieces(path)
        n_tokens, ids_sha, decoded_sha = [], [], []
        for value in batch.column("text"):
            parts = model.parts_of(value.as_py() or "")
            joined = ",".join(map(model.joined_ids, parts))
            decoded = "".join(parts).replace(BLANK, " ")[1:]
            n_tokens.append(joined.count(",") + 1 if parts else 0)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n_tokens, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return map_batches(_rows(df, id_col, text_col), DIGESTS, run)
