"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads a window word by word. A word has a word input, how strongly the word itself marks
toxic texts, and character inputs, how strongly its runs of 4 to 6 bytes do. Network and inputs are
trained here with numpy on a bounded sample of labelled documents. A document's score is the largest
score of its windows, which overlap and cover the whole text. A long word, such as a passage written
without spaces, counts as several words: pieces that overlap so that each run lies in one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import Numbered, carried, map_batches, ragged, read, remainder, schema_of, texts_of
from cohortlens.session import tune

WINDOW, STEP = 128, 96  # words
UNITS = 6  # of each direction
POSITIVE, NEGATIVE = 1000, 2000  # documents of either class in the sample
PER_DOCUMENT = 4  # windows of a document in the sample
SEED = 7
RUNS = (4, 5, 6)  # bytes
PIECE = 64  # bytes of a word from which it is cut
CUT = b"\xff"  # stands where a piece was cut from its word; no byte of a text
EPOCHS, GROUP, RATE = 4, 96, 0.015
SURE = 3.0  # standard errors from which a word or run counts
KEPT = 200_000  # words kept from batch to batch
PORTION = 20_000  # words whose runs are looked at together
EDGE = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^@0123456789…«»“”‘’¡¿"


def cells(text: str) -> list[bytes]:
    """Words of a text; of long ones the pieces."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [piece for word in words for piece in pieces(word)]


def pieces(word: bytes) -> list[bytes]:
    """The word if it is short, else pieces of at most ``PIECE`` bytes between whole characters.

    Neighbours share at least all bytes of a run but one, so each run of the word is in a piece.
    """
    if len(word) <= PIECE or len(word := bare(word)) <= PIECE:
        return [word]
    out, at = [], 0
    while True:
        end = _character(word, min(at + PIECE, len(word)))
        out.append((CUT if at else b"") + word[at:end] + (CUT if end < len(word) else b""))
        if end == len(word):
            return out
        at = _character(word, end - (max(RUNS) - 1))


def _character(word: bytes, at: int) -> int:
    """Start of the character that holds the byte, the end of the word for the byte behind it."""
    while at < len(word) and word[at] & 0xC0 == 0x80:
        at -= 1
    return at


def starts(n: int) -> range:
    """Starts of the windows of a text of ``n`` words; an empty text has one empty window."""
    return range(0, max(1, n - (WINDOW - STEP)), STEP)


def bare(word: bytes) -> bytes:
    if word[:1] == CUT or word[-1:] == CUT:
        return word
    return word.decode("utf-8", "surrogatepass").strip(EDGE).encode("utf-8", "surrogatepass")


def marked(word: bytes) -> bytes:
    """The word with marks at its ends, a piece with marks at those ends where it wasn't cut."""
    return (b"" if word[:1] == CUT else b"^") + word.strip(CUT) + (b"" if word[-1:] == CUT else b"$")


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes of the marked words as numbers, and the word of each."""
    flat = np.frombuffer(b"".join(b"\0" + marked(w) for w in words) + b"\0", np.uint8)
    owner = np.cumsum(flat == 0) - 1
    keys, whose = [], []
    for size in RUNS:
        n = len(flat) - size + 1
        if n <= 0:
            continue
        key, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(size):
            key = key << np.uint64(8) | flat[j: j + n].astype(np.uint64)
            whole &= flat[j: j + n] != 0
        keys.append(key[whole])
        whose.append(owner[:n][whole])
    return np.concatenate(keys), np.concatenate(whose)


def strength(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Standard errors by which the toxic share exceeds ``rate``, from ``SURE`` on, in units of four."""
    n = np.maximum(toxic + clean, 1)
    z = (toxic - n * rate) / np.sqrt(n * rate * (1 - rate))
    return np.clip((z - SURE) / 4, 0, 3)


@dataclass
class Model:
    """Inputs of words and runs, and the weights of the network. Empty: nothing was learned."""

    words: dict[bytes, float] = field(default_factory=dict)
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Inputs of distinct words: one, word, strongest run, mean of the runs."""
        if len(words) > PORTION:
            return np.concatenate([self.inputs(words[i: i + PORTION]) for i in range(0, len(words), PORTION)])
        plain = [bare(w) for w in words]
        out = np.zeros((len(words), 4), np.float32)
        out[:, 0] = 1
        out[:, 1] = [self.words.get(w, 0.0) for w in plain]
        if len(self.runs) and words:
            keys, whose = runs(plain)
            at = np.minimum(np.searchsorted(self.runs, keys), len(self.runs) - 1)
            mark = np.where(self.runs[at] == keys, self.marks[at], 0)
            np.maximum.at(out[:, 2], whose, mark.astype(np.float32))
            n = np.bincount(whose, minlength=len(words))
            out[:, 3] = np.bincount(whose, mark, len(words)) / np.maximum(n, 1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _direction(w: dict[str, np.ndarray], d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction, (time, rows, UNITS); x is (time, rows, inputs), mask (time, rows, 1)."""
    h = np.zeros((x.shape[1], UNITS), np.float32)
    gates = x @ w["x" + d] + w["b" + d]
    out = np.empty((len(x), x.shape[1], UNITS), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        inner = h @ w["h" + d]
        zr = sigmoid(gates[t, :, : 2 * UNITS] + inner[:, : 2 * UNITS])
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        new = np.tanh(gates[t, :, 2 * UNITS:] + r * inner[:, 2 * UNITS:])
        after = h + mask[t] * (1 - z) * (new - h)
        if keep is not None:
            keep.append((t, h, z, r, new, inner))
        out[t] = h = after
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: list | None = None):
    """Logits of windows, and what the backward pass needs."""
    kept = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_direction(w, d, x, mask, k) for d, k in zip("fb", kept, strict=True)], 2)
    view = np.tanh(h @ w["a"])
    weight = np.where(mask[..., 0] > 0, view @ w["v"], -30)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[..., None] * h).sum(0)
    logit = pooled @ w["o"] + w["c"]
    if keep is not None:
        keep.extend((kept, h, view, weight, pooled))
    return logit


def backward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: list, error: np.ndarray) -> dict:
    """Gradients of all weights; ``error`` is the gradient of the loss at the logits."""
    kept, h, view, weight, pooled = keep
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["o"], g["c"] = pooled.T @ error, np.array([error.sum()], np.float32)
    d_pooled = error[:, None] * w["o"]
    d_h = weight[..., None] * d_pooled
    d_weight = (h * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0)) * (mask[..., 0] > 0)
    g["v"] = np.einsum("trk,tr->k", view, d_score)
    d_view = d_score[..., None] * w["v"] * (1 - view**2)
    g["a"] = np.einsum("tri,trk->ik", h, d_view)
    d_h = d_h + d_view @ w["a"].T
    for d, steps, part in zip("fb", kept, (slice(0, UNITS), slice(UNITS, None)), strict=True):
        after = np.zeros((x.shape[1], UNITS), np.float32)
        for t, before, z, r, new, inner in reversed(steps):
            after = after + d_h[t, :, part]
            m = mask[t]
            d_new = after * m * (1 - z) * (1 - new**2)
            d_z = after * m * (before - new) * z * (1 - z)
            d_r = d_new * inner[:, 2 * UNITS:] * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_new], 1)
            d_inner = np.concatenate([d_z, d_r, d_new * r], 1)
            g["x" + d] += x[t].T @ d_gate
            g["b" + d] += d_gate.sum(0)
            g["h" + d] += before.T @ d_inner
            after = after * (1 - m * (1 - z)) + d_inner @ w["h" + d].T
    return g


def train(windows: Iterable[bytes], documents: list[int], toxic: list[int]) -> Model:
    """Model from sampled windows (words joined by spaces), the document of each and its label."""
    labels = np.array(toxic)
    model = Model()
    if not len(labels) or labels.min() == labels.max():
        return model
    index = Numbered()
    codes = [index.codes([w.split()]).astype(np.int32) for w in windows]
    # the document frequency of words and runs in either class
    label_of = dict(zip(documents, toxic, strict=True))
    rate = sum(label_of.values()) / len(label_of)
    bares = Numbered()
    bare_of = bares.codes([[bare(w) for w in index]])
    plain = list(bares)
    of: dict[int, list[np.ndarray]] = {}
    for document, code in zip(documents, codes, strict=True):
        of.setdefault(document, []).append(bare_of[code])
    sets = {d: np.unique(np.concatenate(parts)) for d, parts in of.items()}
    counts = np.zeros((2, len(plain)))
    for document, some in sets.items():
        counts[label_of[document], some] += 1
    mark = np.where(counts[1] > 1, strength(counts[1], counts[0], rate), 0)
    model.words = {plain[i]: float(mark[i]) for i in np.flatnonzero(mark) if plain[i]}

    def runs_of(document: int) -> np.ndarray:
        return np.unique(runs([plain[i] for i in sets[document] if plain[i]] or [b""])[0])

    of_toxic = [runs_of(d) for d in sets if label_of[d]]
    found, n = np.unique(np.concatenate(of_toxic), return_counts=True)
    found, n = found[n > 1], n[n > 1]
    clean = np.zeros(len(found), np.int64)
    for document in sets:
        if not label_of[document] and len(found):
            each = runs_of(document)
            at = np.minimum(np.searchsorted(found, each), len(found) - 1)
            clean[at[found[at] == each]] += 1
    mark = strength(n.astype(float), clean.astype(float), rate)
    model.runs, model.marks = found[mark > 0], mark[mark > 0]
    inputs = model.inputs(list(index))
    marks = inputs[:, 1:3].max(1)
    # one window of each document: of a toxic one that with the most marks, of a clean one any
    best: dict[int, tuple[float, int]] = {}
    order = np.random.default_rng(SEED).random(len(codes))
    for i, (document, code) in enumerate(zip(documents, codes, strict=True)):
        rank = float(marks[code].sum()) if toxic[i] else order[i]
        best[document] = max(best.get(document, (-1.0, 0)), (rank, -i))
    use = [-i for rank, i in best.values() if rank > 0]
    if not labels[use].any():
        use = [-i for _, i in best.values()]
    chosen = [codes[i] for i in use]
    model.weights = _fit(inputs, chosen, labels[use])
    model.weights["c"] = model.weights["c"] - _border(model.weights, inputs, codes, labels, chosen, labels[use])
    return model


def _border(weights, inputs, codes, labels, chosen, chosen_labels) -> np.float32:
    """Logit half way between nearly all clean windows and nearly all toxic ones; above the clean ones if they overlap."""

    def logits(some: list) -> np.ndarray:
        parts = [forward(weights, *padded(inputs, some[i: i + 1024])) for i in range(0, len(some), 1024)]
        return np.concatenate([*parts, np.zeros(0, np.float32)])

    clean = logits([c for c, y in zip(codes, labels, strict=True) if not y])
    toxic = logits([c for c, y in zip(chosen, chosen_labels, strict=True) if y])
    low, high = np.quantile(clean, 0.9995), np.quantile(toxic, 0.02)
    return np.float32((low + high) / 2 if low < high else low + 0.01)


def _fit(inputs: np.ndarray, codes: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    shape = {"x": (inputs.shape[1], 3 * UNITS), "h": (UNITS, 3 * UNITS), "b": (3 * UNITS,)}
    w = {k + d: random.normal(0, 0.3, s).astype(np.float32) for d in "fb" for k, s in shape.items()}
    w |= {"a": random.normal(0, 0.3, (2 * UNITS, UNITS)), "v": random.normal(0, 0.3, UNITS)}
    w |= {"o": random.normal(0, 0.3, 2 * UNITS), "c": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    turn = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(codes))
        order = order[np.argsort([len(codes[i]) // 16 for i in order], kind="stable")]
        groups = [order[i: i + GROUP] for i in range(0, len(order), GROUP)]
        for at in random.permutation(len(groups)):
            some = groups[at]
            x, mask = padded(inputs, [codes[i] for i in some])
            keep: list = []
            p = sigmoid(forward(w, x, mask, keep))
            error = (p - labels[some]) * balance[some] / len(some)
            g = backward(w, x, mask, keep, error.astype(np.float32))
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            turn += 1
            for k in w:
                v = g[k] * min(1.0, 5 / max(size, 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def padded(inputs: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (time, rows, 4) and mask (time, rows, 1) of windows of different lengths."""
    sizes = np.array([len(c) for c in codes])
    width = max(1, int(sizes.max(initial=0)))
    table = np.full((len(codes), width), -1, np.int64)
    table[np.repeat(np.arange(len(codes)), sizes), ragged(np.zeros(len(codes)), sizes)] = np.concatenate([*codes, np.zeros(0, np.int64)])
    mask = (table >= 0).T[..., None].astype(np.float32)
    return inputs[np.maximum(table.T, 0)] * mask if len(inputs) else np.zeros((*table.T.shape, 4), np.float32), mask


class Scorer:
    """Scores of texts; inputs of words are kept from batch to batch, up to ``KEPT`` words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index, self.table = Numbered(), np.zeros((0, 4), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not self.model.weights:
            return np.zeros(len(texts))
        if len(self.index) > KEPT:
            self._clear()
        parts = [cells(t) for t in texts]
        codes = self.index.codes(parts)
        if len(self.index) > len(self.table):
            self.table = np.concatenate([self.table, self.model.inputs(list(self.index)[len(self.table):])])
        sizes = np.array([len(p) for p in parts], np.int64)
        ahead = np.cumsum(sizes) - sizes
        begin = [np.array(starts(n)) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in begin])
        begin = np.concatenate(begin)
        length = np.minimum(WINDOW, sizes[owner] - begin)
        begin = begin + ahead[owner]
        out = np.zeros(len(texts))
        by = np.argsort(length, kind="stable")
        for i in range(0, len(by), 1024):
            some = by[i: i + 1024]
            x, mask = padded(self.table, [codes[begin[j]: begin[j] + length[j]] for j in some])
            np.maximum.at(out, owner[some], sigmoid(forward(self.model.weights, x, mask)).astype(float))
        return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[bytes], list[int], list[int]]:
    """Windows, document number and label of the sampled documents.

    At most ``POSITIVE`` and ``NEGATIVE`` documents, those of smallest hash, and of each at most
    ``PER_DOCUMENT`` windows at even distances: a bounded amount, whatever the tables hold.
    """
    rows = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull())
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    rows = rows.withColumn("at", F.xxhash64("id", F.lit(SEED)))
    chosen = [
        rows.where(F.col("toxic") == c).orderBy("at", "id").limit(n) for c, n in ((1, POSITIVE), (0, NEGATIVE))
    ]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # POSITIVE + NEGATIVE rows
    texts = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).join(chosen, "id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"id": [], "start": [], "toxic": [], "words": []}
        for key, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(2)), texts_of(batch.column(2)), strict=True):
            words = cells(text)
            at = starts(len(words))
            for i in np.unique(np.linspace(0, len(at) - 1, min(len(at), PER_DOCUMENT)).astype(int)):
                out["id"].append(key)
                out["start"].append(at[i])
                out["toxic"].append(toxic)
                out["words"].append(b" ".join(words[at[i]: at[i] + WINDOW]))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("start", pa.int64()), ("toxic", pa.int32()), ("words", pa.binary())]))

    found = map_batches(texts.select("id", "toxic", "text"), run, "id long, start long, toxic int, words binary").toArrow()
    # a key with several rows counts once; in a fixed order
    table = found.group_by(["id", "start"]).aggregate([("toxic", "max"), ("words", "min")]).sort_by([("id", "ascending"), ("start", "ascending")])
    return table["words_min"].to_pylist(), table["id"].to_pylist(), table["toxic_max"].to_pylist()


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Network trained on a bounded sample of labelled documents (see ``sample``).

    Labels other than 0 and 1, null keys and documents without text rows are left out; of repeated
    labels the larger counts. With labels of one class only, or none, the model is empty.
    """
    return train(*sample(docs, labels, key, text, label))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, score) of every row: the largest score of the overlapping windows of its whole text.

    With ``carry`` the column ``row`` holds the row itself, so that nothing needs to be joined.

    Null and empty texts are one empty window. An empty model scores 0. Repeated rows and null keys
    are scored like any other row; other columns are ignored.
    """
    scorer: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not scorer:
            scorer.append(Scorer(model))
        found = scorer[0](texts_of(batch.column(1)))
        columns = [batch.column(0), pa.array(found, pa.float64()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "score", "row"][: len(columns)])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string"), *carried(docs, carry))
    return map_batches(rows, run, schema_of(rows, "score double")).withColumnRenamed("key", key)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned; a null id is one of them."""
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(True))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned from the labels that aren't held out."""
    tune(spark)
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    found = score(docs, learn(docs, labels.where(~held_out(F.col("doc_id")))))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
