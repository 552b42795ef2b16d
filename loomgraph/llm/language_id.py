"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
of its splits into pieces, by a forward pass over its positions; a text's is the product over its words. Piece
probabilities are learned by expectation maximisation over the word counts of labelled documents: forward and backward
passes give each piece's expected count in each language.

Words are runs of letters, lower-cased, with the vocabulary's word mark before them. A letter outside the vocabulary
has one small probability in every language. The learned sample is bounded by a number of documents for each language;
counting and the passes over words run on executors, and the driver gets at most a number for each language and piece.

Nulls: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned. Rows
with a null lang or doc_id teach nothing. Repeated rows give repeated results; of languages that are equally likely the
first by name is taken. Only doc_id, text and lang are read, other columns are ignored. An empty table gives no rows. A very
long text is a chunk of its own (some 20 bytes of memory for each letter); a word of very many letters takes about 10
microseconds a letter. The model is a number for each piece and language, so languages should be counted in hundreds.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common as C

MARK = "▁"
#: Documents for each language that are learned from, in expectation (the share is taken by a hash of doc_id).
MOST_DOCUMENTS = 1500
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-8
#: Longer words take the pass over logarithms, where nothing underflows; the sum is the same.
WIDEST = 32
#: Parts of one that expected counts are rounded to.
SHARES = 1 << 20
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces, without its control and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """All prefixes of a vocabulary's pieces by hash: value >= 0 is a piece's number, -1 only a prefix."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        self.number = {p: i for i, p in enumerate(pieces)}
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        keys = np.array([self.hash_of(p) for p in prefixes], np.uint64)
        values = np.array([self.number.get(p, -1) for p in prefixes], np.int32)
        self.bits = (4 * len(keys) - 1).bit_length()
        self.keys, self.values, self.probes = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32), 0
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.values[slot] == -2)
            chosen, first = np.unique(slot[free], return_index=True)
            at = free[first]
            self.keys[chosen], self.values[chosen] = keys[at], values[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for char in text:
            h = (h * C.BASE + ord(char) + 1) & (2**64 - 1)
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(C.SHINGLE_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere prefix, -2 for neither."""
        slot = self._slot(keys)
        out = self.values[slot]
        open_ = np.flatnonzero((out != -2) & (self.keys[slot] != keys))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.values[slot[open_]]
            open_ = open_[(out[open_] != -2) & (self.keys[slot[open_]] != keys[open_])]
        out[open_] = -2
        return out

    def lattice(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Pieces in words of one length: (start, length) to the rows and their piece (-1: an unknown letter)."""
        rows, width = codes.shape
        found = {}
        for start in range(width):
            live, key = np.arange(rows), np.zeros(rows, np.uint64)
            for length in range(1, min(self.longest, width - start) + 1):
                key = key * np.uint64(C.BASE) + codes[live, start + length - 1] + np.uint64(1)
                value = self.find(key)
                use = np.flatnonzero(value >= 0) if length > 1 else np.arange(len(live))
                if len(use):
                    found[start, length] = (live[use], np.maximum(value[use], -1))
                keep = value != -2
                live, key = live[keep], key[keep]
                if not len(live):
                    break
        return found


def forward(lattice: dict, rows: int, width: int, p: np.ndarray) -> np.ndarray:
    """Probability of each prefix of each word by language, summed over its splits. p: pieces (and last the unknown letter) by languages."""
    alpha = np.zeros((width + 1, rows, p.shape[1]))
    alpha[0] = 1
    for start, length in sorted(lattice):
        at, piece = lattice[start, length]
        alpha[start + length][at] += alpha[start][at] * p[piece]
    return alpha


def backward(lattice: dict, rows: int, width: int, p: np.ndarray) -> np.ndarray:
    beta = np.zeros((width + 1, rows, p.shape[1]))
    beta[width] = 1
    for start, length in sorted(lattice, key=lambda x: -x[0]):
        at, piece = lattice[start, length]
        beta[start][at] += p[piece] * beta[start + length][at]
    return beta


def splits_of(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number (-1: an unknown letter) of every piece in one long word, all places at once, by their ends."""
    found, live, key = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    for length in range(1, min(pieces.longest, len(codes)) + 1):
        inside = live + length <= len(codes)
        live, key = live[inside], key[inside]
        key = key * np.uint64(C.BASE) + codes[live + length - 1] + np.uint64(1)
        value = pieces.find(key)
        use = value >= 0 if length > 1 else np.ones(len(live), bool)
        found.append((live[use], live[use] + length, np.maximum(value[use], -1)))
        live, key = live[value != -2], key[value != -2]
    start, end, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order]


def log_sums(start: np.ndarray, end: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Log of the summed weights of all ways from place 0 to each place (steps by their ends), without underflow."""
    out = np.zeros((n + 1, weight.shape[1]))
    bounds = np.searchsorted(end, np.arange(1, n + 2)).tolist()
    for place in range(1, n + 1):
        a, b = bounds[place - 1], bounds[place]
        here = (np.exp(out[start[a:b]] - out[place - 1]) * weight[a:b]).sum(axis=0)
        out[place] = out[place - 1] + np.log(here)
    return out


def log_long(pieces: Pieces, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of one long word by language."""
    start, end, piece = splits_of(pieces, codes)
    return log_sums(start, end, p[piece], len(codes))[-1]


def expected_long(pieces: Pieces, codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one long word and how often each is expected, by one language's probabilities."""
    start, end, piece = splits_of(pieces, codes)
    n, weight = len(codes), p[piece][:, None]
    ahead = log_sums(start, end, weight, n)[:, 0]
    order = np.argsort(n - start, kind="stable")
    behind = log_sums(n - end[order], n - start[order], weight[order], n)[:, 0]
    return piece, np.exp(ahead[start] + np.log(weight[:, 0]) + behind[n - end] - ahead[-1])


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


class Words:
    """The distinct letter runs of a chunk of texts, each with the mark before it."""

    table: np.ndarray | None = None

    def __init__(self, texts: list[str | None]):
        if Words.table is None:
            Words.table = _letters()
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = Words.table[codes]
        edges = np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.cumsum([0] + [len(t) + 1 for t in lowered])
        self.firsts = np.searchsorted(starts, offsets)
        hashes = C.span_hashes(codes.view(np.uint8), 4 * starts, 4 * ends)
        _, at, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        self.codes, self.starts, self.sizes = codes, starts[at], (ends - starts)[at]

    def by_length(self):
        """(numbers of words, matrix of codes) by length, the mark put first."""
        for size in np.unique(self.sizes).tolist():
            rows = np.flatnonzero(self.sizes == size)
            matrix = np.full((len(rows), size + 1), ord(MARK), np.uint64)
            matrix[:, 1:] = self.codes[self.starts[rows][:, None] + np.arange(size)]
            yield rows, matrix

    def text_of(self, i: int) -> str:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes().decode("utf-32-le", "surrogatepass")


def log_words(pieces: Pieces, found: Words, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found.sizes), p.shape[1]))
    for rows, codes in found.by_length():
        if codes.shape[1] > WIDEST:
            for row, own in zip(rows.tolist(), codes):
                out[row] = log_long(pieces, own, p)
        else:
            out[rows] = np.log(np.maximum(forward(pieces.lattice(codes), len(rows), codes.shape[1], p)[-1], 1e-300))
    return out


def expected(pieces: Pieces, texts: list[str], language: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece by language, each share rounded to 1 / SHARES: whole numbers have one sum in any order."""
    total = np.zeros(p.shape, np.int64)
    sizes = np.array([len(t) for t in texts])
    whole = lambda x: np.rint(x * SHARES).astype(np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        codes = np.frombuffer("".join(MARK + texts[r] for r in rows.tolist()).encode("utf-32-le"), np.uint32).reshape(len(rows), size + 1).astype(np.uint64)
        own = language[rows]
        if size + 1 > WIDEST:
            for word, name, n in zip(codes, own.tolist(), weight[rows].tolist()):
                piece, share = expected_long(pieces, word, p[:, name])
                np.add.at(total, (piece, name), whole(n * share))
            continue
        lattice = pieces.lattice(codes)
        alpha, beta = (f(lattice, len(rows), size + 1, p)[:, np.arange(len(rows)), own] for f in (forward, backward))
        share = weight[rows] / np.maximum(alpha[-1], 1e-300)
        for (start, length), (at, piece) in lattice.items():
            np.add.at(total, (piece, own[at]), whole(share[at] * alpha[start][at] * p[piece, own[at]] * beta[start + length][at]))
    return total


def learn(docs: DataFrame, path: str, most: int = MOST_DOCUMENTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece (last: of an unknown letter) in each."""
    spark = docs.sparkSession
    pieces = Pieces(pieces_of(path))
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & C.trainable(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((pieces.n + 1, 0))
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col("lang") == name) & C.hash_share(F.col("doc_id"), min(1.0, most / counts[name])))

    def count(batch: pa.RecordBatch) -> dict:
        tally: Counter[tuple[str, str]] = Counter()
        by_language: dict[str, list] = {}
        for text, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by_language.setdefault(name, []).append(text)
        for name, texts in by_language.items():
            found = Words(texts)
            for i, n in enumerate(np.bincount(found.code, minlength=len(found.sizes)).tolist()):
                tally[name, found.text_of(i)] += n
        return {"lang": pa.array([k[0] for k in tally], pa.string()), "word": pa.array([k[1] for k in tally], pa.string()), "n": pa.array(list(tally.values()), pa.int64())}

    sample = C.map_texts(labelled.where(chosen), "lang string, word string, n bigint", count)
    table = C.checkpointed(sample.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    number = {name: i for i, name in enumerate(languages)}
    p = np.full((pieces.n + 1, len(languages)), 1 / pieces.n)
    p[-1] = UNKNOWN
    known = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def passes(batches, now=now):
            total = np.zeros(now.value.shape, np.int64)
            for batch in batches:
                own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                total += expected(known.value, batch.column("word").to_pylist(), own, batch.column("n").to_numpy().astype(float), now.value)
            piece, language = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece), "language": pa.array(language), "n": pa.array(total[piece, language])})

        got = table.mapInArrow(passes, "piece bigint, language bigint, n bigint").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        p = np.full_like(p, SMOOTHING)
        p[-1] = 0
        p[got["piece"].to_numpy(), got["language"].to_numpy()] += got["n"].to_numpy() / SHARES
        p /= p.sum(axis=0)
        p[-1] = UNKNOWN
    return languages, p


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Language and posterior probability of every text of docs(doc_id, text)."""
    languages, _ = model
    shared = docs.sparkSession.sparkContext.broadcast((Pieces(pieces_of(path)), model[1]))  # a number for each piece and language

    def work(batch: pa.RecordBatch) -> dict:
        pieces, p = shared.value
        found = Words(batch.column("text").to_pylist())
        n = batch.num_rows
        some = np.diff(found.firsts) > 0
        best, score = np.full(n, -1), np.zeros(n)
        if len(languages) and some.any():
            total = np.add.reduceat(log_words(pieces, found, p)[found.code], found.firsts[:-1][some], axis=0)
            total -= total.max(axis=1, keepdims=True)
            best[some], score[some] = total.argmax(axis=1), 1 / np.exp(total).sum(axis=1)
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "lang_pred": pa.array([languages[i] if i >= 0 else "und" for i in best.tolist()], pa.string()),
            "score": pa.array(score),
        }

    return C.map_texts(docs.select("doc_id", "text", C.held_out(F.col("doc_id")).alias("held_out")), SCHEMA, work, most=2 * C.CHUNK_BYTES)


def identify(docs: DataFrame, path: str) -> DataFrame:
    return predict(docs, path, learn(docs, path))
