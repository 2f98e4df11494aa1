"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  Probabilities come
from a few rounds of expectation maximisation over the words of a bounded sample of
labelled documents (``per_language``), the only thing that is sampled.

Words are runs of letters (Unicode category L), lower-cased; a word of more than 32 letters is scored
in parts of 32, which no segmentation crosses.  All pieces of the vocabulary that consist of letters take part.
Probabilities are carried with a factor for each character, so that no word leaves the range of floats.
A null text or one without letters is ``und`` with score 0.
Without labelled documents everything is ``und``; of languages that tie, the first by name is taken; repeated
rows get equal predictions; an empty table gives an empty result.  Only id and text are inputs of a
prediction; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LANGUAGE = 400
ROUNDS = 4
LONGEST = 32
UNKNOWN = 1e-7
SMOOTHING = 0.02
MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
#: Factor of a probability for each character it accounts for.
LIFT = 1e6
SLICE_CHARS = 2 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-cased letter pieces, with or without the word mark, of a public vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix(MARK)
        if body.isalpha() or piece == MARK:
            found.add(piece)
    return sorted(found)


def _hash(points: np.ndarray) -> np.ndarray:
    """Prefix hashes (n, length + 1) of rows of code points."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        out[:, j + 1] = out[:, j] * _A + (points[:, j].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return out


_POWERS = np.array([pow(int(_A), k, 1 << 64) for k in range(LONGEST + 2)], np.uint64)


class Pieces:
    """The vocabulary by hash."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        values = np.array([self.one(p) for p in pieces], np.uint64)
        self.order = np.argsort(values)
        self.values = values[self.order]
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def one(piece: str) -> int:
        return int(_hash(np.array([[ord(c) for c in piece]], np.uint32))[0, -1])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hashed piece, -1 for none."""
        at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
        return np.where(self.values[at] == h, self.order[at], -1)

    def lattice(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]]:
        """For the words of each length: their indices, and by end position the (start, piece)
        edges; the last entry of a probability table stands for an unknown character."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            index = np.flatnonzero(lengths == n)
            points = np.array([words[i] for i in index], f"U{n}").view(np.uint32).reshape(len(index), n)
            prefix = _hash(points)
            edges: list[list[tuple[int, np.ndarray]]] = [[]]
            for end in range(1, n + 1):
                own = []
                for size in range(1, min(end, self.longest) + 1):
                    piece = self.find(prefix[:, end] - prefix[:, end - size] * _POWERS[size])
                    if size == 1:
                        own.append((end - 1, np.where(piece < 0, len(self.pieces), piece)))
                    elif (piece >= 0).any():
                        own.append((end - size, np.where(piece < 0, len(self.pieces) + 1, piece)))
                edges.append(own)
            yield index, edges


def _table(p: np.ndarray) -> np.ndarray:
    """Probabilities with a row for unknown characters and one for no piece."""
    return np.concatenate((p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))))


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability (word, language), summed over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for index, edges in pieces.lattice(words):
        alpha = [np.ones((len(index), table.shape[1]))]
        for own in edges[1:]:
            total = np.zeros((len(index), table.shape[1]))
            for start, piece in own:
                total += alpha[start] * (table[piece] * LIFT ** (len(alpha) - start))
            alpha.append(total)
        out[index] = np.log(alpha[-1]) - (len(edges) - 1) * np.log(LIFT)
    return out


def fit(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (piece, language) from counts (word, language)."""
    n, langs = len(pieces.pieces), counts.shape[1]
    p = np.full((n, langs), 1.0 / n)
    lattices = list(pieces.lattice(words))
    for _ in range(rounds):
        table = _table(p)
        expected = np.zeros((n + 2, langs))
        for index, edges in lattices:
            shape = (len(index), langs)
            alpha = [np.ones(shape)]
            for own in edges[1:]:
                alpha.append(sum((alpha[s] * (table[x] * LIFT ** (len(alpha) - s)) for s, x in own), np.zeros(shape)))
            beta = [np.zeros(shape) for _ in edges]
            beta[-1] = counts[index] / np.maximum(alpha[-1], 1e-300)
            for end in range(len(edges) - 1, 0, -1):
                for s, x in edges[end]:
                    flow = table[x] * LIFT ** (end - s) * beta[end]
                    beta[s] += flow
                    used = alpha[s] * flow
                    for k in range(langs):
                        expected[:, k] += np.bincount(x, used[:, k], n + 2)
        p = expected[:n] + SMOOTHING
        p /= p.sum(0)
    return p


def _words(text: str | None) -> list[str]:
    out = []
    for w in LETTERS.findall((text or "").lower()):
        out.append(MARK + w if len(w) <= LONGEST else MARK + w[:LONGEST])
        if len(w) > LONGEST:
            out.extend(w[i : i + LONGEST] for i in range(LONGEST, len(w), LONGEST))
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "word": [_words(t) for t in batch.column("text").to_pylist()]})
        frame = frame.explode("word").dropna().groupby(["lang", "word"]).size().reset_index(name="n")
        yield pa.RecordBatch.from_pandas(frame.astype({"lang": str, "word": str, "n": "int64"}), preserve_index=False, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, path: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) from rows (doc_id, text, lang).  About
    ``per_language`` rows of each language are read, chosen by a hash of their id."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, names = sorted(sizes), vocabulary(path)
    if not languages:
        return [], names, np.zeros((len(names), 0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_language / n)) for k, n in sizes.items()])
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counted = labelled.where(place < share).mapInArrow(_count_words, "lang string, word string, n long")
    frame = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    wide = frame.pivot_table(index="word", columns="lang", values="n", fill_value=0).reindex(columns=languages, fill_value=0).sort_index()
    if not len(wide):
        return [], names, np.zeros((len(names), 0))
    return languages, names, fit(list(wide.index), wide.to_numpy(float), Pieces(names))


def _predict(languages: list[str], names: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = Pieces(names), _table(p)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            labels, values = [], []
            texts = batch.column("text")
            at = 0
            while at < len(texts):
                words, ends, size = [], [], 0
                while at < len(texts) and (not ends or size < SLICE_CHARS):
                    text = texts[at].as_py() or ""
                    words.extend(_words(text))
                    ends.append(len(words))
                    size += len(text)
                    at += 1
                code, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, int), [])
                if len(known) > 1_000_000:
                    known, scores = {}, scores[:0]
                fresh = [w for w in distinct if w not in known]
                if fresh:
                    known.update(zip(fresh, range(len(scores), len(scores) + len(fresh)), strict=True))
                    scores = np.concatenate((scores, word_scores(fresh, pieces, table)))
                place = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))
                total = np.zeros((len(words) + 1, len(languages)))
                np.cumsum(scores[place][code] if len(words) else np.zeros((0, len(languages))), axis=0, out=total[1:])
                bounds = np.array([0, *ends])
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if a == b or not languages:
                        labels.append("und")
                        values.append(0.0)
                        continue
                    own = total[b] - total[a]
                    best = int(own.argmax())
                    labels.append(languages[best])
                    values.append(round(float(1 / np.exp(np.maximum(own - own[best], -700)).sum()), 6))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score.  Documents whose crc32(id as text) mod 4 is 2
    are held out; a row without an id is neither held out nor learned from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    languages, names, p = learn(rows.where(F.col("lang").isNotNull() & ~held), per_language, path)
    rows = rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(languages, names, p), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
