"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The chance of a word is the sum, over
all its segmentations into pieces, of the products of their probabilities, found by a forward pass; pieces do not cross
words, so a text's chance is the product over its words. Probabilities are learned by expectation-maximisation, with
forward and backward passes over the same lattice. Each distinct word is scored once by a worker.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.shared import as_text, ready
from pairforge.llm.vectext import Known, hashed, pieces, words

#: About so many labelled documents of each language, chosen by a hash of their id, are learned from.
MAX_LABELLED = 400
ROUNDS, FLOOR, UNKNOWN = 4, 0.01, -16.0
CACHE = 500_000
#: Words of more bytes (texts without blanks) are scored in one pass along the word, and cut for learning.
LONG = 512
_MARK = "▁"

#: Bytes of words: letters after lower-casing and everything outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model that hold letters; a word's beginning is a blank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        p = model.id_to_piece(i)
        body = p.removeprefix(_MARK)
        if _MARK not in body and all(c.isalpha() or ord(c) >= 128 for c in body):
            out.add(((" " if p != body else "") + body.lower()).encode())
    return sorted(out - {b""})


class Lattice:
    """The places of vocabulary pieces in words of one length."""

    def __init__(self, vocab: list[bytes]):
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lens = np.array([len(p) for p in vocab])
        flat = np.frombuffer(b"".join(vocab), np.uint8)
        ends = np.cumsum(lens)
        h = hashed(flat, ends - lens, ends)
        for n in np.unique(lens).tolist():
            at = np.flatnonzero(lens == n)
            order = np.argsort(h[at])
            self.by_len[n] = h[at][order], at[order]
        self.size = len(vocab)

    def edges(self, matrix: np.ndarray):
        """Yields (end, start, words, pieces; the piece is the size of the vocabulary for an unknown character), end ascending."""
        n, length = matrix.shape
        flat = np.ascontiguousarray(matrix).ravel()
        begins = (matrix & 0xC0) != 0x80
        rows = np.arange(n)
        found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        single = np.zeros((n, length), bool)  # a character with a piece of its own
        for size, (keys, ids) in self.by_len.items():
            for s in range(length - size + 1):
                who = rows[begins[:, s] & (begins[:, s + size] if s + size < length else True)]
                if not len(who):
                    continue
                a = who * length + s
                h = hashed(flat, a, a + size)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if hit.any():
                    found[s + size].append((s, who[hit], ids[at[hit]]))
                    alone = hit.copy()
                    if size > 1:
                        alone &= begins[who, s + 1 : s + size].sum(1) == 0
                    single[who[alone], s] = True
        for s in range(length):
            who = rows[begins[:, s] & ~single[:, s]]
            if len(who):
                tail = begins[who, s + 1 :]
                size = np.where(tail.any(1), tail.argmax(1), length - s - 1) + 1
                for k in np.unique(size).tolist():
                    w = who[size == k]
                    found[s + k].append((s, w, np.full(len(w), self.size)))
        for e in range(1, length + 1):
            for s, who, ids in sorted(found[e], key=lambda x: x[0]):
                yield e, s, who, ids

    def forward(self, matrix: np.ndarray, logp: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log chances (place, word, language) of all beginnings of the words; the last are those of the words."""
        n, length = matrix.shape
        alpha = np.full((length + 1, n, logp.shape[1]), -np.inf)
        alpha[0] = 0
        for e, s, who, ids in self.edges(matrix):
            alpha[e, who] = np.logaddexp(alpha[e, who], alpha[s, who] + logp[ids])
            if keep is not None:
                keep.append((e, s, who, ids))
        return alpha


    def forward_long(self, word: bytes, logp: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The log chances of one long word, blank included: what forward() gives, in time and memory in proportion to its length."""
        data, length = np.frombuffer(word, np.uint8), len(word)
        begins = np.append((data & 0xC0) != 0x80, True)
        chars = np.flatnonzero(begins)
        alpha = np.full((length + 1, logp.shape[1]), -np.inf)
        alpha[0] = 0
        for lo in range(0, length, block):
            at = chars[(chars >= lo) & (chars < min(lo + block, length))]
            after = chars[np.searchsorted(chars, at) + 1]
            alone = np.zeros(len(at), bool)
            starts, ends, pieces_ = [], [], []
            for size, (keys, ids) in self.by_len.items():
                who = np.flatnonzero(at + size <= length)
                who = who[begins[at[who] + size]]
                h = hashed(data, at[who], at[who] + size)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                who = who[hit]
                alone[who] |= at[who] + size == after[who]
                starts.append(at[who]), ends.append(at[who] + size), pieces_.append(ids[place[hit]])
            other = np.flatnonzero(~alone)
            starts.append(at[other]), ends.append(after[other]), pieces_.append(np.full(len(other), self.size))
            s, e, p = (np.concatenate(x) for x in (starts, ends, pieces_))
            order = np.argsort(s, kind="stable")
            s, e, weight = s[order], e[order], logp[p[order]]
            cut = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)).tolist()
            for i, j in zip(cut[:-1], cut[1:], strict=True):  # from one place no two pieces end alike
                to = e[i:j]
                alpha[to] = np.logaddexp(alpha[to], alpha[s[i]] + weight[i:j])
        return alpha[length]


def parted(word: bytes, most: int = LONG) -> list[bytes]:
    """A word cut into parts of at most `most` bytes, between characters."""
    out = []
    while len(word) > most:
        n = next(k for k in range(most, 0, -1) if word[k] & 0xC0 != 0x80)
        out.append(word[:n])
        word = word[n:]
    return [*out, word]


def by_length(texts: list[bytes], most: int = 2_000_000):
    """Words with the blank before them as matrices of one length, and their places."""
    lens = np.array([len(t) for t in texts])
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        step = max(1, most // ((n + 1) * 4))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            matrix = np.frombuffer(b"".join(b" " + texts[i] for i in part.tolist()), np.uint8).reshape(len(part), n + 1)
            yield part, matrix


def learn(counts: dict[str, dict[bytes, int]], vocab: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each piece in each; the last row is the unknown character."""
    lattice, langs = Lattice(vocab), sorted(counts)
    logp = np.full((len(vocab) + 1, len(langs)), -np.log(len(vocab)))
    logp[-1] = UNKNOWN
    kept: dict[int, list] = {}
    for l, lang in enumerate(langs):
        cut: dict[bytes, int] = {}
        for word, n in counts[lang].items():
            for part in parted(word) if len(word) > LONG else [word]:
                cut[part] = cut.get(part, 0) + n
        texts, weights = list(cut), np.array(list(cut.values()), np.float64)
        stored: list[tuple[np.ndarray, int, int, list]] = []
        for part, matrix in by_length(texts):
            keep: list = []
            lattice.forward(matrix[:, :], logp[:, l : l + 1], keep)
            stored.append((weights[part], *matrix.shape, keep))
        kept[l] = stored
    for _ in range(ROUNDS):
        for l in range(len(langs)):
            p, total = logp[:, l], np.zeros(len(vocab) + 1)
            for w, n, length, edges in kept[l]:
                alpha = np.full((length + 1, n), -np.inf)
                alpha[0] = 0
                for e, s, who, ids in edges:
                    alpha[e, who] = np.logaddexp(alpha[e, who], alpha[s, who] + p[ids])
                beta = np.full((length + 1, n), -np.inf)
                beta[length] = 0
                for e, s, who, ids in reversed(edges):
                    through = beta[e, who] + p[ids]
                    total += np.bincount(ids, np.exp(alpha[s, who] + through - alpha[length, who]) * w[who], len(total))
                    beta[s, who] = np.logaddexp(beta[s, who], through)
            mass = total[:-1] + FLOOR
            logp[:-1, l] = np.log(mass / mass.sum())
    return langs, logp


class Scorer:
    """Log chances of words in each language, kept for the next slices."""

    def __init__(self, vocab: list[bytes], logp: np.ndarray):
        self.lattice, self.logp = Lattice(vocab), logp
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.values = np.zeros((1 << 12, self.logp.shape[1]))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each row, the log chance of its words in each language."""
        s = words(data, offsets, LETTERS)
        n, k = len(offsets) - 1, self.logp.shape[1]
        if not len(s.hash):
            return np.zeros((n, k))
        h, where, inverse = np.unique(s.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(h) > CACHE:
            self.clear()
        numbers = self.known.find(h)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            raw = data.tobytes()
            w = where[missing]
            texts = [raw[a:b] for a, b in zip(s.start[w].tolist(), s.end[w].tolist(), strict=True)]
            base = len(self.known)
            while base + len(missing) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            short = np.array([i for i, t in enumerate(texts) if len(t) <= LONG], np.int64)
            for part, matrix in by_length([texts[i] for i in short.tolist()]):
                self.values[base + short[part]] = self.lattice.forward(matrix, self.logp)[-1]
            for i, t in enumerate(texts):
                if len(t) > LONG:
                    self.values[base + i] = self.lattice.forward_long(b" " + t, self.logp)
            numbers[missing] = self.known.add(h[missing])
        each = self.values[numbers[inverse]]
        return np.column_stack([np.bincount(s.row, each[:, j], n) for j in range(k)])


def scorer(key: str, vocab: list[bytes], logp: np.ndarray) -> Scorer:
    """This process's scorer of the newest model."""
    kept = sys.modules.setdefault("_pairforge_scorer", type(sys)("_pairforge_scorer")).__dict__
    if kept.get("key") != key:
        kept["key"], kept["scorer"] = key, Scorer(vocab, logp)
    return kept["scorer"]


def train(docs: DataFrame, vocab: list[bytes], max_labelled: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """Learns from docs (doc_id, text in lower case, lang) whose crc32(doc_id as text) mod 4 is not 2."""
    own = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((len(vocab) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 30) * min(1, max_labelled / n)) + 1)])
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        total: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, _, data, offsets in pieces(batch.column(1)):
                s, raw = words(data, offsets, LETTERS), data.tobytes()
                for r, a, b in zip(s.row.tolist(), s.start.tolist(), s.end.tolist(), strict=True):
                    key = langs[lo + r], raw[a:b]
                    total[key] = total.get(key, 0) + 1
        items = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())], names=["lang", "word", "n"])

    table = own.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow()
    counts: dict[str, dict[bytes, int]] = {lang: {} for lang in sizes}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][bytes(word)] = n
    return learn(counts, vocab)


def identify(documents: DataFrame, vocabulary_path: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of documents: doc_id, held_out, lang_pred, score.

    score is the chance of lang_pred among the learned languages, all equally likely before. Null texts and texts
    without letters are und with score 0, and so is every text if no language can be learned. Rows that repeat are
    scored each; a row without doc_id is not learned from and not held out. Empty tables give empty results; texts
    are read whole, however long, also without blanks. The model has a column for each value of lang, which must be
    few (languages). Other columns are ignored, whatever their names.
    """
    spark = ready(documents.sparkSession)
    docs = as_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")))
    docs = docs.withColumn("text", F.lower("text"))
    vocab = vocabulary(vocabulary_path)
    langs, logp = train(docs, vocab, max_labelled)
    model = spark.sparkContext.broadcast((vocab, langs, logp))
    key = str(model.id if hasattr(model, "id") else id(model)) + spark.sparkContext.applicationId + str(float(np.abs(logp).sum()))

    def scan(batches):
        vocab, langs, logp = model.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                if langs:
                    total = scorer(key, vocab, logp).score(data, offsets)
                    best = total.argmax(1)
                    chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                else:
                    best, chance = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                letters = np.array([any(map(str.isalpha, t)) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]) & bool(langs)
                best = np.where(letters, best, len(langs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, chance, 0.0))], names=["doc_id", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
