"""Languages of whole documents and of their segments, by a byte convolutional network.

The network (byte embedding, filters of several widths, max pooling, softmax) is trained in numpy on a
bounded sample of labelled rows; labels it then disagrees with are dropped and it is trained again, as
some are wrong. All texts are then cut into sentences, code, marks and identifiers are left out, and the
sentences are classified in batches of fixed-length byte windows. Equal sentences of a task are
classified once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "ja", "pt", "zh"]

# How languages are spelled in labels (before any "-" or "_").
SPELLINGS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english englisch",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "ja": "ja jp jpn japanese 日本語",
    "pt": "pt por portuguese português portugues",
    "zh": "zh cn zho chi cmn chinese mandarin 中文 汉语",
}

WINDOW = 96
WIDTHS = (2, 3, 4, 5)

CODE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??[ \t>]*\1[`~]*|^[ \t>]*(?:`{3,}|~{3,})[^\n]*\n.*\Z", re.M | re.S)
END = re.compile(r"[\n|]+|(?<=[.!?…])[\"”’»)*]*\s+|(?<=[。！？])|(?<=[a-zà-ÿ0-9][.!?])(?=[A-ZÀ-Þ぀-ヿ㐀-鿿])")
LEADING = re.compile(r"^(?:[\s>#*+\-•→✓·]|\d+[.)]\s|(?:User|Assistant|System):)+")
SPECIAL = re.compile(r"[0-9@/_\\{}=<>`]|[A-Za-z]\.[A-Za-z]")
MASK = re.compile(r"[!-~]*(?:[0-9@/_\\{}=<>`]|[A-Za-z]\.[A-Za-z])[!-~]*")
WORDS = re.compile(r"[^\W\d_]+")
WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def canonical(label: str | Column) -> Column:
    """The two-letter language of a label, however spelled; null if it names none of them."""
    table = [v for code, names in SPELLINGS.items() for name in names.split() for v in (F.lit(name), F.lit(code))]
    bare = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(F.create_map(*table), F.regexp_extract(bare, r"^([^-_ (]*)", 1)))


def sentences(text: str) -> list[tuple[str, bool]]:
    """(text without code, marks and identifiers, whether it is a whole sentence), in order."""
    if "```" in text or "~~~" in text:
        text = CODE.sub("\n", text)
    made = []
    for part in END.split(text):
        if not part or part.isspace():
            continue
        part = LEADING.sub("", part).rstrip(" \t\r\"”’»)*_")
        if not part or part[0] in "{[<":
            continue
        ended = part[-1] in ".!?。！？…"
        wide = 0 if part.isascii() else len(WIDE.findall(part))
        if not SPECIAL.search(part):
            bare = " ".join(part.split())
        elif wide:  # no spaces between words: only the ASCII runs can be told apart
            bare = " ".join(MASK.sub(" ", part).split())
        else:
            bare = " ".join([t for t in part.split() if not SPECIAL.search(t)])
        enough = wide >= 5 or (not wide and bare.count(" ") >= 2)
        made.append((bare, ended and enough))
    return made


def windows(text: str) -> list[bytes]:
    """Fixed-length byte windows that cover the whole text."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= WINDOW:
        return [raw]
    step = WINDOW * 3 // 4
    return [raw[i : i + WINDOW] for i in range(0, len(raw) - WINDOW // 4, step)]


def as_matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in raw), dtype=np.uint8).reshape(len(raw), WINDOW)


@dataclass
class Network:
    """Weights of the byte convolutional network; classify() is all that the workers need."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 7, size: int = 10, count: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        f4 = np.float32
        return Network(
            (rng.normal(0, 0.5, (256, size))).astype(f4),
            [rng.normal(0, (2 / (w * size)) ** 0.5, (w * size, count)).astype(f4) for w in WIDTHS],
            [np.zeros(count, f4) for _ in WIDTHS],
            rng.normal(0, 0.1, (count * len(WIDTHS), len(LANGUAGES))).astype(f4),
            np.zeros(len(LANGUAGES), f4),
        )

    def features(self, x: np.ndarray, keep: bool = False):
        e = self.embed[x]
        n, length, size = e.shape
        pooled, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            s = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * size), (e.strides[0], e.strides[1], e.strides[2]))
            a = (s.reshape(-1, w * size) @ f).reshape(n, length - w + 1, -1)
            if keep:
                at = a.argmax(axis=1)
                where.append(at)
                top = np.take_along_axis(a, at[:, None, :], 1)[:, 0]
            else:
                top = a.max(axis=1)
            pooled.append(np.maximum(top + b, 0))
        return e, np.concatenate(pooled, axis=1), where

    def classify(self, raw: list[bytes], batch: int = 256) -> np.ndarray:
        """Class probabilities of each window."""
        made = []
        x = as_matrix(raw)
        for i in range(0, len(x), batch):
            z = self.features(x[i : i + batch])[1] @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            made.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(made) if made else np.zeros((0, len(LANGUAGES)))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rate: float, hard: np.ndarray | None = None, batch: int = 64, seed: int = 3) -> None:
        """Adam on the cross entropy, classes alike; only the filters' best positions carry gradients.
        hard: rows of which a third of each batch is taken."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, *self.filters, *self.biases, self.out, self.out_bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        size, count = self.embed.shape[1], self.biases[0].size
        members = [np.flatnonzero(y == k) for k in np.unique(y)]
        rows = np.arange(batch)[:, None]
        for step in range(1, steps + 1):
            kinds = rng.integers(len(members), size=batch)
            take = np.array([members[k][rng.integers(len(members[k]))] for k in kinds])
            if hard is not None and len(hard):
                take[: batch // 3] = hard[rng.integers(len(hard), size=batch // 3)]
            xb, yb = x[take], y[take]
            e, h, where = self.features(xb, keep=True)
            z = h @ self.out + self.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            dh = (p @ self.out.T) * (h > 0)
            grads_f, grads_b, ids, backs = [], [], [], []
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * count : (k + 1) * count]
                spans = where[k][:, :, None] + np.arange(w)
                patch = e[rows[:, :, None], spans].reshape(batch, count, w * size)
                grads_f.append(np.matmul(d.T[:, None, :], patch.transpose(1, 0, 2))[:, 0].T)
                grads_b.append(d.sum(axis=0))
                ids.append(xb[rows[:, :, None], spans].ravel())
                backs.append((d[:, :, None] * self.filters[k].T[None]).reshape(-1, size))
            byte, back = np.concatenate(ids), np.concatenate(backs)
            order = np.argsort(byte, kind="stable")
            byte, back = byte[order], back[order]
            starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            g_embed = np.zeros_like(self.embed)
            g_embed[byte[starts]] = np.add.reduceat(back, starts)
            grads = [g_embed, *grads_f, *grads_b, h.T @ p, p.sum(axis=0)]
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)


def fit(texts: list[str], labels: list[str], steps: int = 1300) -> Network:
    """Train on labelled texts. Some labels are wrong: after each phase, texts whose windows speak for
    another language than their label, and windows that do so by themselves, are left out of the next.
    Without labelled text the network is untrained."""
    raw: list[bytes] = []
    of: list[int] = []
    for i, text in enumerate(texts):
        new = [w for bare, whole in sentences(text) if whole for w in windows(bare)]
        raw += new
        of += [i] * len(new)
    network = Network.fresh()
    if not raw:
        return network
    x, doc = as_matrix(raw), np.array(of)
    y = np.array([LANGUAGES.index(label) for label in labels])[doc]
    keep, hard = np.ones(len(y), dtype=bool), None
    for share, rate in ((0.3, 0.004), (0.4, 0.002), (0.3, 0.001)):
        network.train(x[keep], y[keep], max(1, int(steps * share)), rate, hard)
        p = network.classify(raw)
        whole = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(whole, doc, np.log(p + 1e-4))
        sure = (whole.argmax(axis=1)[doc] == y) & (p.argmax(axis=1) == y)
        if set(np.unique(y[sure])) == set(np.unique(y)):
            keep = sure
        hard = np.flatnonzero(p[np.arange(len(y)), y][keep] < 0.98)
    return network


def labelled_sample(texts: DataFrame, key: str, text: str, label: str, per_label: int = 600) -> DataFrame:
    """text and canonical label of at most per_label rows of each language, chosen by the hash of the key."""
    rows = texts.select(F.col(key).alias("k"), canonical(label).alias("label")).where("label is not null and k is not null").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label)
    return texts.select(F.col(key).alias("k"), F.col(text).alias("body")).where("body is not null").join(F.broadcast(picked), "k").select("body", "label")


def trained(texts: DataFrame, key: str = "memory_id", text: str = "content", label: str = "language", per_label: int = 600) -> Network:
    """The network, fitted to a sample of at most per_label rows a language (4,200 rows at the default)."""
    sample = labelled_sample(texts, key, text, label, per_label).toPandas().sort_values(["label", "body"])
    return fit(sample["body"].tolist(), sample["label"].tolist())


# a language other than a text's main one counts from this confidence of one of its sentences on
LEAST = 0.995


class Reader:
    """Classifies the sentences of batches of texts; equal sentences once."""

    def __init__(self, network: Network, remember: int = 200_000):
        self.network, self.remember, self.known = network, remember, {}

    def learn(self, wanted: list[str]) -> None:
        new = [s for s in dict.fromkeys(wanted) if s not in self.known]
        if len(self.known) + len(new) > self.remember:
            self.known = {s: self.known[s] for s in wanted if s in self.known}
        raw = [windows(s) for s in new]
        p = self.network.classify([w for ws in raw for w in ws])
        at = 0
        for s, ws in zip(new, raw):
            mean = p[at : at + len(ws)].mean(axis=0)
            at += len(ws)
            best = int(mean.argmax())
            self.known[s] = (LANGUAGES[best], float(mean[best]))

    def read(self, texts: list[str | None]) -> list[tuple[list[str], list[dict]]]:
        """For each text its languages, and its segments: language, confidence, number of sentences."""
        parts = [sentences(t) if t else [] for t in texts]
        for k, found in enumerate(parts):
            if not any(w for _, w in found):  # no whole sentence: what there is decides
                rest = " ".join(b for b, _ in found if b)
                parts[k] = [(rest, True)] if WORDS.search(rest) else []
        self.learn([b for found in parts for b, whole in found if whole])
        made = []
        for found in parts:
            segments: list[dict] = []
            best: Counter[str] = Counter()
            number: Counter[str] = Counter()
            for bare, whole in found:
                if not whole:
                    continue
                language, p = self.known[bare]
                best[language] = max(best[language], p)
                number[language] += 1
                if segments and segments[-1]["language"] == language:
                    s = segments[-1]
                    s["confidence"] = (s["confidence"] * s["sentences"] + p) / (s["sentences"] + 1)
                    s["sentences"] += 1
                else:
                    segments.append({"language": language, "confidence": p, "sentences": 1})
            main = max(number, key=lambda c: (number[c], best[c]), default=None)
            made.append((sorted(c for c in best if c == main or best[c] >= LEAST), segments))
        return made


SEGMENTS = "languages array<string>, segments array<struct<language: string, confidence: double, sentences: int>>"


def detect(items: DataFrame, network: Network, keys: list[str], text: str = "content", others: list[str] | None = None) -> DataFrame:
    """The keys and others, languages (sorted) and segments of every row.

    A null, empty or wordless text has no languages and no segments. Rows are judged one by one, so
    repeated rows come out repeated. A text in which no whole sentence stands is judged as a whole.
    """
    kept = [*keys, *(others or [])]
    names = [f"c{i}" for i in range(len(kept))]
    rows = items.select(*[F.col(k).alias(n) for k, n in zip(kept, names)], F.col(text).alias("body"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(network)
        for batch in batches:
            read = reader.read([b if isinstance(b, str) else None for b in batch.pop("body")])
            batch["languages"] = [r[0] for r in read]
            batch["segments"] = [r[1] for r in read]
            yield batch

    return rows.mapInPandas(run, f"{kinds}, {SEGMENTS}").select(*[F.col(n).alias(k) for k, n in zip(kept, names)], "languages", "segments")
