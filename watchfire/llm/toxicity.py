"""Toxicity: a gapped subsequence kernel, Nystroem landmarks and a support vector machine trained on labelled sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, shuffle_width, slices
from watchfire.llm.logistic import fit_logistic, probability

#: The kernel: each character that a subsequence spans, taken or skipped, weighs this factor.
DECAY = 0.7
#: Subsequences have three or four characters, and span so many at most: one of four can have two skipped ones.
SPANS = {3: 5, 4: 6}
#: Subsequences are numbered by a hash of so many bits. Two with one number count as one; a text of the size of a window
#: has some hundred of them, so a chance meeting moves a score by less than a hundredth.
BITS = 20
#: Stands between words and at both ends: a blank is one more character that a subsequence may skip.
EDGE = "\x02"
#: A longer word is cut into pieces of so many characters; windows are one or two words or pieces.
PIECE = 12
#: Characters that are scored at a time, and the longest run of them that counts as one word.
STREAM, LONGEST = 100_000, 4096
#: A word spelt out in so many one-letter words or more is also read as one.
SPELT = 4
#: Sentences that train the machine are cut at . ! ? and line ends.
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Rounds of choosing the windows that stand for a toxic sentence, and training on them.
ROUNDS = 3
#: Training windows that are laid out as a matrix at a time.
TRAIN_BLOCK = 100
#: Features of a document: its three highest window scores, log of its windows above 0, log of its windows.
FEATURES = 5
#: No score counts as less than this.
FLOOR = -2.0
_MARKS = re.compile(r"[^\w\s]+|_+")


def _shapes(prefix: tuple[int, ...] = (0,)) -> Iterator[tuple[int, ...]]:
    """Offsets of a subsequence's characters, those with a common beginning after one another."""
    if len(prefix) in SPANS and prefix[-1] < SPANS[len(prefix)]:
        yield prefix
    if len(prefix) < max(SPANS):
        for o in range(prefix[-1] + 1, max(SPANS.values())):
            yield from _shapes((*prefix, o))


_SHAPES = tuple(_shapes())


def _norms() -> np.ndarray:
    """By number of characters: the norm of a text whose subsequences are all different."""
    n = np.arange(1, 4 * LONGEST)
    return np.sqrt(sum(np.maximum(0, n - s[-1]) * DECAY ** (2 * (s[-1] + 1)) for s in _SHAPES)) + 1e-12


_NORM = np.concatenate(([1e-12], _norms()))


def subsequences(chars: np.ndarray) -> Iterator[tuple[int, float, np.ndarray]]:
    """(last offset, weight, number of the subsequence that starts at each place) for each shape."""
    made: dict[tuple[int, ...], np.ndarray] = {(0,): chars * np.uint32(0x9E3779B1)}
    for shape in _SHAPES:
        for k in range(2, len(shape) + 1):
            if shape[:k] not in made:
                made = {p: h for p, h in made.items() if p == shape[: len(p)]}
                n, h = max(0, len(chars) - shape[k - 1]), made[shape[: k - 1]]
                made[shape[:k]] = (h[:n] ^ (h[:n] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[shape[k - 1] :][:n]
        h = made[shape]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(len(shape))
        yield shape[-1], DECAY ** (shape[-1] + 1), h >> np.uint32(32 - BITS)


def _words(text: str) -> list[str]:
    """Lower-case words without marks, overlong ones in overlapping parts, and the words that single letters spell."""
    words = _MARKS.sub("", text.lower()).split()
    sizes = list(map(len, words))
    if sizes.count(1) >= SPELT:
        one = np.flatnonzero(np.array(sizes) == 1)
        runs = np.split(one, np.flatnonzero(np.diff(one) > 1) + 1)
        words += ["".join(words[i] for i in r.tolist()) for r in runs if len(r) >= SPELT]
    if sizes and max(sizes) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST - 2 * PIECE)]
    return words


@dataclass
class Windows:
    """Windows of one or two words (pieces of long ones) of texts that follow each other in one array of characters.
    start and end are the places of the edges, both in the window; owner is the text."""

    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, list[str]]]) -> Windows:
        """parts: (owner, words), each a text or a part of one."""
        joined = "".join(f"{EDGE}{EDGE.join(w)}{EDGE}" for _, w in parts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = np.flatnonzero(chars == ord(EDGE))
        part = np.repeat(np.arange(len(parts)), [len(w) + 1 for _, w in parts])
        long = np.flatnonzero((np.diff(cuts) > 2 * PIECE + 1) & (part[1:] == part[:-1]))
        if len(long):
            more = [np.arange(cuts[i] + PIECE, cuts[i + 1] - PIECE // 2, PIECE) for i in long.tolist()]
            cuts, part = np.concatenate([cuts, *more]), np.concatenate([part, *(np.full(len(m), part[i]) for i, m in zip(long.tolist(), more))])
            order = np.argsort(cuts, kind="stable")
            cuts, part = cuts[order], part[order]
        pairs = [(cuts[:-k], cuts[k:], part[:-k], part[k:]) for k in (1, 2)]
        start, end, first, last = (np.concatenate(x) for x in zip(*pairs))
        ok = (first == last) & (end - start > 2)
        owners = np.array([o for o, _ in parts], np.int64)
        return cls(chars, start[ok].astype(np.int32), end[ok].astype(np.int32), owners[first[ok]].astype(np.int32))

    def text(self, i: int) -> str:
        return self.chars[self.start[i] : self.end[i] + 1].tobytes().decode("utf-32-le", "surrogatepass")

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of the weights of each window's subsequences, over the norm of the window."""
        by_last: dict[int, np.ndarray] = {}
        for last, weight, number in subsequences(self.chars):
            found = weights[number] * np.float32(weight)
            by_last[last] = by_last[last] + found if last in by_last else found
        total = np.zeros(len(self.start))
        for last, found in by_last.items():
            upto = np.concatenate(([0.0], np.cumsum(found, dtype=np.float64)))
            low = np.minimum(self.start, len(found))
            total += upto[np.maximum(low, self.end - last + 1)] - upto[low]
        return total / _NORM[self.end - self.start + 1]


def streams(texts: list[str | None]) -> Iterator[Windows]:
    """All windows of the texts, some STREAM characters at a time; a long text goes on with its last word."""
    parts, held = [], 0
    for owner, text in enumerate(texts):
        words = _words(text) if text else []
        each = len(words) if not words or len(text) <= STREAM else max(2, STREAM * len(words) // len(text))
        for a in range(0, len(words), max(1, each - 1)):
            if a and a + 1 == len(words):
                break  # the part before has ended with this word
            parts.append((owner, words[a : a + each]))
            held += sum(map(len, parts[-1][1])) + len(parts[-1][1])
            if held > STREAM:
                yield Windows.of(parts)
                parts, held = [], 0
            if a + each >= len(words):
                break
    if parts:
        yield Windows.of(parts)


def phi(windows: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """The windows' subsequence weights, over their norms, in the columns that `column` gives to the numbers."""
    size = np.fromiter(map(len, windows), np.int64, len(windows))
    chars = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(windows)), size)
    index, weights = [np.empty(0, np.int64)], [np.empty(0)]
    for last, weight, number in subsequences(chars):
        n = len(number)
        at = column[number]
        ok = (row[:n] == row[last : last + n]) & (at >= 0)
        index.append(row[:n][ok] * width + at[ok].astype(np.int64))
        weights.append(np.full(len(index[-1]), weight))
    out = np.bincount(np.concatenate(index), np.concatenate(weights), len(windows) * width)
    return (out.reshape(len(windows), width) / _NORM[size][:, None]).astype(np.float32)


@dataclass
class Machine:
    """A decision function over windows: since Nystroem features are linear in the kernel values with the landmarks, and
    these in the weights of subsequences, the support vector machine is one weight for each subsequence's number."""

    weights: np.ndarray
    bias: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        out[:, :3] = FLOOR
        top = [np.full(0, FLOOR)] * len(texts)
        for w in streams(texts):
            s = np.maximum(w.sums(self.weights) + self.bias, FLOOR)
            order = np.lexsort((-s, w.owner))
            owner = w.owner[order]
            first = np.flatnonzero(np.concatenate((owner[:1] == owner[:1], owner[1:] != owner[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)]):
                i, own = owner[a], s[order[a:b]]
                top[i] = np.concatenate((top[i], own[:3]))
                out[i, 3] += np.searchsorted(-own, 0.0)
                out[i, 4] += b - a
        for i, t in enumerate(top):
            best = np.sort(t)[::-1][:3]
            out[i, : len(best)] = best
        out[:, 3:] = np.log1p(out[:, 3:])
        return out


def _spread(windows: list[str], n: int) -> list[str]:
    """n of the windows, each as unlike those before as can be (pivots of a Cholesky decomposition of their kernel, taken
    over subsequences' numbers modulo 512)."""
    if len(windows) <= n:
        return windows
    x = np.concatenate([phi(windows[i : i + TRAIN_BLOCK], np.arange(1 << BITS, dtype=np.int32) % 512, 512) for i in range(0, len(windows), TRAIN_BLOCK)])
    left, out, basis = (x * x).sum(axis=1), [], np.zeros((len(x), n), np.float32)
    for k in range(n):
        i = int(np.argmax(left))
        if left[i] <= 1e-6:
            break
        out.append(i)
        basis[:, k] = (x @ x[i] - basis[:, :k] @ basis[i, :k]) / np.sqrt(left[i])
        left = left - basis[:, k] ** 2
        left[i] = 0
    return [windows[i] for i in out]


def train_machine(up: list[str], down: list[str], landmarks: int = 200) -> Machine:
    """A linear support vector machine (squared hinge) on Nystroem features of toxic and clean windows. Half of the
    landmarks are toxic windows, half clean ones, each chosen to be unlike one another."""
    if not up or not down:
        return Machine(np.zeros(1 << BITS, np.float32), -1.0)
    marks = _spread(up, landmarks // 2) + _spread(down, landmarks // 2)
    numbers = np.unique(np.concatenate([n for m in marks for _, _, n in subsequences(np.frombuffer(m.encode("utf-32-le", "surrogatepass"), np.uint32))]))
    column = np.full(1 << BITS, -1, np.int32)
    column[numbers] = np.arange(len(numbers))
    lm = phi(marks, column, len(numbers))
    vals, vecs = np.linalg.eigh((lm @ lm.T).astype(float))
    ok = vals > 1e-4 * vals.max()
    # Nystroem: phi(x) = k(x, landmarks) @ vectors / sqrt(values), and k(x, landmarks) = x @ landmarks.
    basis = (lm.T @ (vecs[:, ok] / np.sqrt(vals[ok]))).astype(np.float32)
    rows = [*up, *down]
    y = np.repeat([1.0, -1.0], [len(up), len(down)])
    z = np.ones((len(rows), basis.shape[1] + 1), np.float32)
    for i in range(0, len(rows), TRAIN_BLOCK):
        z[i : i + TRAIN_BLOCK, :-1] = phi(rows[i : i + TRAIN_BLOCK], column, len(numbers)) @ basis
    cost = np.where(y > 0, 1 / len(up), 1 / len(down))
    w, ridge = np.zeros(z.shape[1]), np.diag([*[1e-3] * basis.shape[1], 1e-6])
    for step in range(40):  # Newton's method on the squared hinge loss, damped if it goes on for long
        pull = np.where(y * (z @ w) < 1, cost, 0.0)
        new = np.linalg.solve((z * pull[:, None]).T @ z + ridge, z.T @ (pull * y))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new if step < 15 else 0.5 * w + 0.5 * new
    weights = np.zeros(1 << BITS, np.float32)
    weights[numbers] = basis @ w[:-1]
    return Machine(weights, float(w[-1]))


def _streams_of(texts: list[str]) -> Iterator[tuple[Windows, np.ndarray]]:
    """The windows of the texts' sentences, and the text of each window. No window spans two sentences."""
    cut = [(i, x) for i, t in enumerate(texts) for x in _SENTENCE.findall(t)]
    owner = np.array([i for i, _ in cut], np.int64)
    for w in streams([x for _, x in cut]):
        yield w, owner[w.owner]


def _leaning(sample: DataFrame) -> np.ndarray | None:
    """Of each number of a subsequence, how much more frequent it is in toxic sentences than in clean ones, from -1 to 1; None
    if a side has none. Tasks count, Spark adds and divides, and the driver gets a small number for each of the
    2 ** BITS numbers, whatever the size of the sample."""
    schema = pa.schema([("number", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for b in slices(batches, 50):
            texts, toxic = b.column("text").to_pylist(), np.asarray(b.column("toxic"))
            for y in (0, 1):
                for w, _ in _streams_of([t for t, z in zip(texts, toxic) if z == y]):
                    for _, _, number in subsequences(w.chars):
                        found[y] += np.bincount(number, minlength=1 << BITS)
        number = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(found[0, number]), pa.array(found[1, number])], schema=schema)

    sums = materialise(sample.select("toxic", "text").mapInArrow(count, "number int, clean long, toxic long").groupBy("number").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    clean, toxic = sums.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not clean or not toxic:
        return None
    c, t = F.col("clean") / clean, F.col("toxic") / toxic
    found = sums.select("number", ((t - c) / (t + c + 4 / toxic)).cast("float").alias("leaning")).toPandas()
    out = np.zeros(1 << BITS, np.float32)
    out[found["number"].to_numpy()] = found["leaning"].to_numpy()
    return out


def _content_hash(w: Windows) -> np.ndarray:
    """A number of each window that depends on its first and last characters only."""
    last, _, number = next(subsequences(w.chars))
    top = max(0, len(number) - 1)
    ends = [number[np.minimum(x, top)].astype(np.int64) for x in (w.start, w.end - last)] if len(number) else [np.zeros(len(w.start), np.int64)] * 2
    return ((ends[0] * 2_654_435_761) ^ (ends[1] * 40_503)) % 1_000_003


def _chosen(sample: DataFrame, weights: np.ndarray, each: int):
    """Of each document the `each` windows with the highest sums of weights (place from 0), and as many others, those of
    least hash (place -1): rows (doc, toxic, score, place, window)."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc", pa.int64()), ("toxic", pa.int64()), ("score", pa.float64()), ("place", pa.int64()), ("text", pa.string())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 50):
            texts = b.column("text").to_pylist()
            best: list[dict[str, float]] = [{} for _ in texts]
            other: list[dict[str, float]] = [{} for _ in texts]
            for w, owner in _streams_of(texts):
                score, mark = w.sums(shared.value), _content_hash(w)
                for kept, by, value in ((best, -score, score), (other, mark, mark)):
                    order = np.lexsort((by, owner))
                    new = np.flatnonzero(np.concatenate((owner[:1] == owner[:1], owner[order][1:] != owner[order][:-1])))
                    for at, end in zip(new.tolist(), [*new[1:].tolist(), len(order)]):
                        found: set[str] = set()
                        for i in order[at:end].tolist():
                            found.add(w.text(i))
                            kept[owner[i]].setdefault(w.text(i), value[i])
                            if len(found) == each:
                                break
            rows = []
            for i, (doc, toxic) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist())):
                rows += [(doc, toxic, x, k, t) for k, (t, x) in enumerate(sorted(best[i].items(), key=lambda kv: (-kv[1], kv[0]))[:each])]
                rows += [(doc, toxic, None, -1, t) for t, _ in sorted(other[i].items(), key=lambda kv: kv[::-1])[:each]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    found = sample.select("doc_id", "toxic", "text").mapInArrow(choose, "doc long, toxic long, score double, place long, text string").toPandas()
    return found.sort_values(["doc", "place", "text"])


def learn(sample: DataFrame, each: int = 2) -> Machine:
    """From the sentences of labelled documents (doc_id, toxic, text), all of them. A toxic document's label holds for some
    of its words only, so it is learnt from its `each` windows that are likeliest toxic (multiple-instance learning): at
    first by how much more frequent their subsequences are in toxic sentences, then by the machine of the round before. The
    clean side is each clean document's likeliest windows and `each` others. Tasks count subsequences and choose the windows;
    the driver gets 2 * each windows a document, all of which train."""
    leaning = _leaning(sample)
    if leaning is None:
        return train_machine([], [])
    machine = Machine(leaning, 0.0)
    for _ in range(ROUNDS):
        found = _chosen(sample, machine.weights, each)
        toxic, score, place = (found[c].to_numpy() for c in ("toxic", "score", "place"))
        # A toxic document whose best window is no likelier than that of most clean ones has none to learn from.
        least = np.median(score[(toxic == 0) & (place == 0)])
        up, down = found["text"][(toxic == 1) & (place >= 0) & (score > least)], found["text"][toxic == 0]
        machine = train_machine(sorted(set(up)), sorted(set(down)))
    return machine


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text mod 5 is 0: rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@dataclass
class ToxicityModel:
    machine: Machine
    weights: np.ndarray

    def toxic(self, texts: list[str | None]) -> np.ndarray:
        """Which texts are predicted toxic."""
        return probability(self.machine.features(texts), self.weights) >= 0.5


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2000) -> ToxicityModel:
    """Learns from at most most_rows toxic and most_rows clean labelled documents, those of least hash of their id, never
    from held-out ones: the only bound. All their sentences train the machine (see learn()), and their whole texts'
    features calibrate. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most_rows) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most 2 * most_rows ids: small enough to broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    sample = materialise(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(shuffle_width(docs.sparkSession)))
    machine = learn(sample)
    fitted = _features(sample.select("text", F.col("toxic").alias("y")), machine, ["y"]).toPandas()
    x = np.array(fitted["x"].tolist(), float).reshape(len(fitted), FEATURES)
    return ToxicityModel(machine, fit_logistic(x, fitted["y"].to_numpy(float)))


def _features(docs: DataFrame, machine: Machine, others: list[str]) -> DataFrame:
    """Columns `others` (long) and x, the features of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = pa.schema([*[(c, pa.int64()) for c in others], ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = shared.value.features(b.column("text").to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], flat], schema=schema)

    return docs.select(*others, "text").mapInArrow(run, ", ".join(f"{c} long" for c in others) + ", x array<double>")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability that the text is toxic), predicted (1 from 0.5) for every row of docs.

    Null and empty texts are scored as texts without words. Every text is scored whole and on its own, so repeated rows agree;
    null ids are carried; an empty table gives no rows. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = _features(slim, model.machine, ["doc_id"])
    w = model.weights
    z = F.lit(float(w[0]))
    for i in range(FEATURES):
        z = z + F.col("x")[i] * F.lit(float(w[i + 1]))
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    return x.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """docs without the rows whose text is predicted toxic, in one pass without a shuffle; all columns, whatever their
    names, stay as they were. Rows are judged by their text alone, so null and repeated ids and rows need no rule."""
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, **kwargs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(~shared.value.toxic(b.column(at).to_pylist())))

    return docs.mapInArrow(clean, docs.schema)
