"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in chunks of ``CHUNK`` bytes, which are a position's context. A forward and a backward network
of ``HIDDEN`` units pass over each chunk; at every position a softmax over the languages is taken from both
states. A document's probabilities are the mean over the positions of its letters, so whole texts of any
length are pooled. The model is trained in numpy by backpropagation through time on the whole texts of a
bounded sample of labelled training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shingles import buffers
from strandline.llm.store import crc_mod, whole_texts

HIDDEN, CHUNK = 6, 64
#: Documents per language in the training sample, about: what bounds the driver's share.
SAMPLE_DOCUMENTS = 300
#: Characters of the sample at most, in whole texts.
MOST_CHARS = 32 << 20
EPOCHS, BATCH, RATE = 1, 64, 0.01
#: Chunks that pass the network together.
GROUP = 2048

_ASCII_LETTER = np.zeros(128, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=bool)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        table[[ord(c) for c in regex.findall(r"\p{L}", every)]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a letter; of a letter that is cut off at the start, bytes don't count."""
    if not len(raw) or raw.max() < 128:
        return _ASCII_LETTER[raw] if len(raw) else np.zeros(0, dtype=bool)
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if not len(at):
        return np.zeros(len(raw), dtype=bool)
    first = raw[at].astype(np.int64)
    length = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(length == 1, first, first & (0x7F >> length))
    for k in range(1, 4):
        more = length > k
        code[more] = code[more] << 6 | raw[np.minimum(at[more] + k, len(raw) - 1)] & 0x3F
    letter = _is_letter()[np.minimum(code, 0x10FFFF)] & (at + length <= len(raw))
    place = np.cumsum(lead) - 1
    return np.where(place >= 0, letter[np.maximum(place, 0)], False)


def squash(x: np.ndarray, scratch: np.ndarray) -> None:
    """Softsign in place, ``x / (1 + |x|)``: the bounded activation, far cheaper in numpy than tanh."""
    np.abs(x, out=scratch)
    scratch += 1
    x /= scratch


class Direction:
    """One recurrent pass. Gates are rows of (3 * HIDDEN, batch): update, reset, candidate."""

    def __init__(self, rng, hidden):
        self.p = {"x": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32), "u": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)}
        self.h = hidden

    def forward(self, ids: np.ndarray, keep: bool):
        """States after each step (steps, hidden, batch); with ``keep`` also what the backward pass needs."""
        n, h2 = self.h, 2 * self.h
        steps, batch = ids.shape
        state = np.zeros((n, batch), np.float32)
        states, kept = np.empty((steps, n, batch), np.float32), []
        table, u = self.p["x"], self.p["u"]
        x, scratch = np.empty((3 * n, batch), np.float32), np.empty((h2, batch), np.float32)
        for t in range(steps):
            np.take(table, ids[t], axis=1, out=x, mode="clip")
            y = u @ state
            gates = x[:h2] + y[:h2]
            squash(gates, scratch)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            c = r * y[h2:]
            c += x[h2:]
            squash(c, scratch[:n])
            new = state - c
            new *= z
            new += c
            if keep:
                kept.append((state, z, r, c, y[h2:]))
            state = states[t] = new
        return states, kept

    def backward(self, ids, kept, d_states):
        n, h2 = self.h, 2 * self.h
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        carry, every = np.zeros_like(d_states[0]), []
        u = self.p["u"]
        for t in range(len(ids) - 1, -1, -1):
            before, z, r, c, yc = kept[t]
            d = d_states[t] + carry
            dc = d * (1 - z) * (1 - np.abs(c)) ** 2
            dz = d * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * yc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dy = np.concatenate([dz, dr, dc * r])
            dx = np.concatenate([dz, dr, dc])
            carry = d * z + u.T @ dy
            grad["u"] += dy @ before.T
            every.append(dx)
        flat, every = ids[::-1].ravel(), np.concatenate(every, axis=1)
        for j in range(3 * n):
            grad["x"][j] = np.bincount(flat, every[j], minlength=256)
        return grad


class Model:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = [Direction(rng, hidden), Direction(rng, hidden)]
        self.out = {"w": rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32), "b": np.zeros((len(languages), 1), np.float32)}

    def probabilities(self, ids: np.ndarray, keep: bool = False):
        """Softmax at every position: (steps, languages, batch). ``ids`` is (steps, batch)."""
        ahead, k0 = self.sides[0].forward(ids, keep)
        back, k1 = self.sides[1].forward(ids[::-1], keep)
        both = np.concatenate([ahead, back[::-1]], axis=1)
        p = np.matmul(self.out["w"], both)
        p += self.out["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, (both, k0, k1)

    def gradients(self, ids, labels, weight):
        """Loss and gradients of the weighted cross-entropy at every position."""
        p, (both, k0, k1) = self.probabilities(ids, keep=True)
        total = max(float(weight.sum()), 1.0)
        batch = np.arange(ids.shape[1])
        loss = -float((np.log(p[:, labels, batch] + 1e-9) * weight).sum()) / total
        p[:, labels, batch] -= 1
        p *= (weight / total)[:, None, :]
        grad_out = {"w": np.einsum("tlb,thb->lh", p, both), "b": p.sum(axis=(0, 2))[:, None]}
        d = np.matmul(self.out["w"].T, p)
        h = self.sides[0].h
        return loss, [self.sides[0].backward(ids, k0, d[:, :h]), self.sides[1].backward(ids[::-1], k1, d[::-1, h:]), grad_out]

    def fit(self, chunks: np.ndarray, weight: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; chunks and weight are (n, steps)."""
        rng = np.random.default_rng(seed)
        params = [self.sides[0].p, self.sides[1].p, self.out]
        first = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        second = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        step, losses = 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(chunks)), 0.0
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                loss, grads = self.gradients(chunks[pick].T, labels[pick], weight[pick].T)
                total += loss * len(pick)
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    for k in p:
                        m[k] = 0.9 * m[k] + 0.1 * g[k]
                        v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                        p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            losses.append(total / max(len(chunks), 1))
        return losses


def chunked(raw: np.ndarray, offsets: np.ndarray, group: int = GROUP):
    """Rows cut into chunks, ``group`` at a time: bytes (chunks, CHUNK), whether each is of a letter, each chunk's row and start."""
    per = -(-np.diff(offsets) // CHUNK)
    ends = np.cumsum(per)
    for k in range(0, int(ends[-1]) if len(ends) else 0, group):
        number = np.arange(k, min(k + group, int(ends[-1])))
        row = np.searchsorted(ends, number, side="right")
        start = offsets[row] + (number - (ends[row] - per[row])) * CHUNK
        stop = np.minimum(start + CHUNK, offsets[row + 1])
        # Letters are told from the bytes around a chunk's ends too.
        a, b = max(int(offsets[0]), int(start[0]) - 4), min(int(offsets[-1]), int(stop[-1]) + 4)
        letters = letter_bytes(raw[a:b])
        place = start[:, None] + np.arange(CHUNK)[None, :]
        valid = place < stop[:, None]
        place = np.where(valid, place, a)
        ids = raw[place]
        ids[~valid] = 32
        yield ids, valid & letters[place - a], row, start


def _predict(model):
    def run(batches):
        net = model.value
        for batch in batches:
            text = batch.column(1)
            raw, offsets = buffers(text)
            n = len(text)
            pooled, count = np.zeros((n, len(net.languages))), np.zeros(n)
            for ids, weight, row, _ in chunked(raw, offsets) if net.languages else ():
                p, _ = net.probabilities(np.ascontiguousarray(ids.T))
                summed = np.einsum("tlb,tb->bl", p, weight.T.astype(np.float32))
                for j in range(len(net.languages)):
                    pooled[:, j] += np.bincount(row, summed[:, j], minlength=n)
                count += np.bincount(row, weight.sum(axis=1), minlength=n)
            mean = pooled / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1) if net.languages else np.zeros(n, int)
            known = count > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([net.languages[j] if ok else "und" for j, ok in zip(best, known)], pa.string()),
                    pa.array([float(min(max(mean[i, j], 0.0), 1.0)) if ok else 0.0 for i, (j, ok) in enumerate(zip(best, known))], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def _runs(model):
    """Runs of letter positions with one label, as byte ranges; what is no letter belongs to the run before it."""

    def run(batches):
        net = model.value
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            out: list[list[dict]] = [[] for _ in range(len(batch.column(1)))]
            for ids, weight, row, start in chunked(raw, offsets) if net.languages else ():
                best = net.probabilities(np.ascontiguousarray(ids.T))[0].argmax(axis=1).T
                for i, at in zip(row.tolist(), range(len(row))):
                    places = np.flatnonzero(weight[at])
                    if len(places):
                        own = best[at][places]
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                        base = int(start[at] - offsets[i])
                        for a, b in zip(cuts[:-1], cuts[1:]):
                            lang, first, last = net.languages[own[a]], base + int(places[a]), base + int(places[b - 1]) + 1
                            if out[i] and out[i][-1]["lang"] == lang:
                                out[i][-1]["stop"] = last
                            else:
                                out[i].append({"start": first, "stop": last, "lang": lang})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])))], names=["doc_id", "runs"])

    return run


def train(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> Model:
    """A model of the non-null languages of the training rows (crc32 of the id's text, modulo 5, not 0).

    The sample takes ids by their hash, about ``per_language`` of each language, and whole texts, ``MOST_CHARS``
    characters in all: a text that is longer than what is left is left out. Of rows with one id the first by language and
    text counts. Without training rows the model knows no language.
    """
    rows = docs.filter((crc_mod(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.filter(place <= share[F.col("lang")]).select("doc_id", "lang", place.alias("place")).distinct()
    first = taken.groupBy("doc_id", "place").agg(F.min("lang").alias("lang"))
    sample = whole_texts(rows.join(F.broadcast(first.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi"), first, MOST_CHARS)
    texts = sorted((r["lang"], r["text"]) for r in sample.collect())
    raw, offsets = buffers(pa.array([t for _, t in texts], pa.string()))
    parts = [*chunked(raw, offsets)]
    labels = np.array([languages.index(lang) for lang, _ in texts])
    model = Model(languages)
    if parts:
        chunks, weight, row = (np.concatenate([p[k] for p in parts]) for k in range(3))
        model.fit(chunks, weight.astype(np.float32), labels[row])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` with score 0 for a text that is null or has no letter.

    Only the text is read: language, source and id take no part, nor any other column. Of languages with equal
    probabilities the first by name is taken. A text of any length is pooled as a whole, ``GROUP`` chunks at a
    time. Repeated rows give repeated results; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(shipped), "doc_id long, lang_pred string, score double")


def label_positions(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, runs``: the label of every letter position, as runs ``start, stop, lang`` of bytes of the UTF-8 text.

    A null text, or one without letters, has no runs. Of languages with equal probabilities the first by name is
    taken. Repeated rows are labelled alike, an empty table gives no rows, other columns are ignored; a text of
    any length is one row's work, ``GROUP`` chunks at a time.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runs(shipped), "doc_id long, runs array<struct<start:long,stop:long,lang:string>>")
