"""SentencePiece encoding and decoding by a table of last tokens.

Byte-pair merging gives each *prefix* of a word exactly one last token: the word's ids are
found by walking over the word once, storing for every prefix its last token, and reading
the ids backwards from the end.  Which vocabulary pieces end at a position comes from an
Aho-Corasick automaton; a piece is the last token exactly when the last token of the
prefix before it may stand in front of it, that is when merging the two pieces' text
would give these two pieces and no other.  That pair test unmakes both pieces' last
merges, the later one first, and looks whether an earlier merge would have crossed the
border between them.

No piece of the vocabulary has a blank mark after another character, or a line feed, so a
text falls apart at blanks and line feeds (checked when a model is loaded; a model that
breaks the rule is encoded text by text).  Each distinct word is encoded once per task and
remembered, in a memory of bounded size, of which little stays when the task ends.

Defined results: null counts as empty text, which has only the begin and end ids; every
input row gives one output row, repeated rows included; an empty table gives an empty
one; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import per_text

MARK = "▁"  # stands for a blank
#: Bounds of what a task remembers: words, characters of a word, pairs of pieces.
MOST_WORDS, LONGEST_KEPT, MOST_PAIRS = 400_000, 64, 1_000_000
#: And of what stays in a worker from task to task.
WORDS_STAY, PAIRS_STAY = 20_000, 200_000


class PieceModel:
    """A merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
        kinds = model.SentencePiece
        if spec.model_type != spec.BPE or not spec.byte_fallback or not plain or norm.remove_extra_whitespaces:
            raise ValueError("a merge-type model with byte fallback and no normalisation is asked for")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.begin, self.end = spec.bos_id, spec.eos_id
        self.text = {i: p.piece for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.id = {t: i for i, t in self.text.items()}
        score = {i: model.pieces[i].score for i in self.text}
        # Merges happen from the best score down, equal scores from the left.
        self.rank = {i: -score[i] for i in self.text if len(self.text[i]) > 1}
        self.byte_id = [0] * 256
        self.bytes = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif p.type == kinds.NORMAL:
                self.bytes[i] = p.piece.replace(MARK, " ").encode()
        self.apart = not any(MARK in t.lstrip(MARK) or "\n" in t for t in self.id)
        self.parts = {i: self._last_merge(t) for i, t in self.text.items() if len(t) > 1}
        whole = [t for i, t in self.text.items() if len(t) == 1 or self.parts[i]]
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            self.automaton.add_word(t, (len(t), self.id[t]))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces that merging ``text`` joins last; None if it never becomes one piece."""
        parts = list(text)
        while len(parts) > 2:
            best = min(
                ((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None),
                default=None,
            )
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts[0] not in self.id or parts[1] not in self.id:
            return None
        return self.id[parts[0]], self.id[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces leaves exactly these two.

        From the last merges backwards: ``a`` and ``b`` are the pieces at the border while
        every merge before ``limit`` has happened.  A join of a and b that comes before the
        merge which hid one of them would have been made instead.
        """
        a, b, limit = left, right, (float("inf"), 1)
        while True:
            joined = self.id.get(self.text[a] + self.text[b])
            # Equal ranks: the left merge comes first, and the join lies right of a's own
            # merges and left of b's.
            if joined is not None and (self.rank[joined], 0) < limit:
                return False
            ra = self.rank[a] if a in self.parts else -float("inf")
            rb = self.rank[b] if b in self.parts else -float("inf")
            if a not in self.parts and b not in self.parts:
                return True
            if ra > rb or (ra == rb and b not in self.parts):
                # a was made by the later merge: before it, its right part stood at the border.
                limit, a = (ra, 0), self.parts[a][1]
            else:
                # A join of equal rank that starts left of b's merge comes before it.
                limit, b = (rb, 1), self.parts[b][0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word whose blanks are marks; the table has one entry per prefix."""
        n = len(word)
        # Of each prefix: length and id of its last token, -1 for a character without a piece.
        size, last = [1] * n, [-1] * n
        pairs, done = self.pairs, -1
        # At each end the automaton gives the longest piece first; a one-character piece
        # always fits, so the first piece that does is the one.
        for at, (length, piece) in self.automaton.iter(word):
            if at == done:
                continue
            before = at - length
            if before >= 0 and (left := last[before]) >= 0:
                pair = left << 32 | piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.fits(left, piece)
                if not fits:
                    continue
            size[at], last[at], done = length, piece, at
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            length, piece = size[at], last[at]
            ids += [piece] if piece >= 0 else [self.byte_id[x] for x in reversed(word[at].encode())]
            at -= length
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, begin and end ids included."""
        if not text:
            return np.array([self.begin, self.end], np.uint32)
        text = MARK + text.replace(" ", MARK)
        words = re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", text) if self.apart else [text]
        known, found = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.word_ids(word), np.uint32).tobytes()
                if len(word) <= LONGEST_KEPT:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[word] = ids
            found.append(ids)
        ends = np.array([self.begin], np.uint32).tobytes(), np.array([self.end], np.uint32).tobytes()
        return np.frombuffer(ends[0] + b"".join(found) + ends[1], "<u4")

    def forget(self) -> None:
        """Keep the words and pairs met first, for the most part the frequent ones."""
        self.known = dict(islice(self.known.items(), WORDS_STAY))
        if len(self.pairs) > PAIRS_STAY:
            self.pairs = dict(islice(self.pairs.items(), PAIRS_STAY))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces put together, the first blank being the one put in front."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode(errors="replace")
        return text.removeprefix(" ")


@lru_cache(2)
def model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every document.

    ``ids`` have begin and end; the digests are of them as little-endian unsigned 32-bit
    integers, and of the text that decoding them gives.
    """

    def start():
        pieces = model(path)

        def of(text: str) -> tuple:
            ids = pieces.encode(text)
            decoded = pieces.decode(ids)
            return (
                len(ids), ids.view(np.int32), hashlib.sha256(ids.tobytes()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )

        return of

    schema = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return per_text(docs, schema, start, id_col, text_col, lambda: model(path).forget())


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the texts of stored ids; null ids give the empty text."""
    plain = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in batches:
            texts = [pieces.decode(np.asarray(x.values)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: as ``tokens``, without the ids themselves."""

    def start():
        pieces = model(path)

        def of(text: str) -> tuple:
            ids = pieces.encode(text)
            back = pieces.decode(ids).encode()
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

        return of

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(docs, schema, start, id_col, text_col, lambda: model(path).forget())
