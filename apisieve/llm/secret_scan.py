"""Secret scans: regular expressions, and a character convolutional network over every candidate, the rules' spans included."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, tune

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the network judges beside the rules' spans: runs of the characters that keys are made of. Words are not among them, nor words joined by signs.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
_WORDS = re.compile(r"[-+/_=]*(?:[A-Za-z]?[a-z]*|[A-Z]+)(?:[-+/_=]+(?:[A-Za-z]?[a-z]*|[A-Z]+))*")

#: Characters of a window and of context on either side; longer candidates are read in overlapping windows.
WINDOW, CONTEXT = 96, 24
RECALL = 0.98
#: Documents whose findings train the network beside the generated ones, whichever hash first, and findings of theirs at most.
SAMPLE_DOCS, SAMPLE_FINDINGS = 400, 4000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the rules' matches, leftmost and non-overlapping per kind; sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidate runs that no base span touches."""
    starts, reach, far = [s for s, _, _ in spans], [], -1
    for _, _, e in spans:
        far = max(far, e)
        reach.append(far)
    out = []
    for m in _CANDIDATE.finditer(text):
        if not _WORDS.fullmatch(text, m.start(), m.end()):
            i = bisect.bisect_left(starts, m.end())  # spans that begin before the run ends
            if not i or reach[i - 1] <= m.start():
                out.append(m.span())
    return out


def plainly_none(run: str) -> bool:
    """Whether a run is surely no secret: words and short numbers joined by signs, or at most three different characters."""
    return len(set(run)) <= 3 or all(p.isalpha() and p[1:].islower() or p.isdigit() and len(p) <= 8 for p in re.split(r"[-+/_=]+", run) if p)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of the candidate in its context, by windows of WINDOW; codes of the candidate itself are marked by 128."""
    rows, body = [], WINDOW - 2 * CONTEXT
    for a in range(start, end, body):
        b = min(a + body, end)
        left = text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\n")
        piece = (left + text[a : b + CONTEXT])[:WINDOW].ljust(WINDOW, "\n")
        code = np.minimum(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.int64)
        code[CONTEXT : CONTEXT + b - a] += 128
        rows.append(code)
    return np.stack(rows)


class CharCNN:
    """Embedding of characters, a convolution of width 5 with ReLU, largest and mean activation, a logistic output."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (256, self.EMBED)), "conv": rng.normal(0, 0.2, (self.WIDTH * self.EMBED, self.FILTERS)), "conv0": np.zeros(self.FILTERS),
            "out": rng.normal(0, 0.2, 2 * self.FILTERS), "out0": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        p, span = self.p, codes.shape[1] - self.WIDTH + 1
        x = p["embed"][codes]
        cols = np.concatenate([x[:, j : j + span] for j in range(self.WIDTH)], axis=2)
        act = np.maximum(cols @ p["conv"] + p["conv0"], 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return cols, act, top, pooled, pooled @ p["out"] + p["out0"]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = 5) -> CharCNN:
        """Adam on batches of 64, by the gradient of the log loss."""
        rng, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 64):
                at = order[i : i + 64]
                cols, act, top, pooled, z = self._forward(codes[at])
                dz = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                dp = dz[:, None] * self.p["out"]
                da = np.repeat(dp[:, None, self.FILTERS :] / act.shape[1], act.shape[1], axis=1)
                n, f = np.indices(top.shape)
                da[n, top, f] += dp[:, : self.FILTERS]
                da *= act > 0
                dcols = da @ self.p["conv"].T
                dx = np.zeros((*codes[at].shape, self.EMBED))
                for j in range(self.WIDTH):
                    dx[:, j : j + act.shape[1]] += dcols[:, :, j * self.EMBED : (j + 1) * self.EMBED]
                de = np.zeros_like(self.p["embed"])
                np.add.at(de, codes[at].ravel(), dx.reshape(-1, self.EMBED))
                grads = {"embed": de, "conv": np.einsum("nsi,nsf->if", cols, da, optimize=True), "conv0": da.sum((0, 1)), "out": pooled.T @ dz, "out0": dz.sum(keepdims=True)}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL) -> CharCNN:
        """Platt's scale and shift on held-out findings, and the highest threshold at which their recall is `recall` or more."""
        a, b = 1.0, 0.0
        for _ in range(500):
            g = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 0.05 * (np.mean(g * z) + 1e-3 * (a - 1)), b - 0.05 * np.mean(g)
        self.scale, self.shift = a, b
        positive = np.sort(self.probability(z)[y == 1])[::-1]
        if len(positive):
            self.threshold = float(positive[min(len(positive) - 1, int(np.ceil(recall * len(positive))) - 1)])
        return self

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def span_logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """The logit of each span, given its windows: that of the window most like a secret. The threshold is calibrated on this."""
        if not rows:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        return np.maximum.reduceat(self.logits(np.concatenate(rows)), starts)

    def fit_spans(self, rows: list[np.ndarray], y: np.ndarray, rounds: int = 2) -> CharCNN:
        """Fit on spans of several windows. A span that is none teaches by all its windows; one that is a secret by the window the network now finds the likeliest, first by all."""
        none = [r for r, label in zip(rows, y, strict=True) if not label]
        some = [r for r, label in zip(rows, y, strict=True) if label]
        for _ in range(rounds):
            x = np.concatenate([*none, *some])
            self.fit(x, np.repeat([0.0, 1.0], [sum(map(len, none)), sum(map(len, some))]), epochs=10 // rounds)
            some = [r[[int(self.logits(r).argmax())]] for r in some]
        return self

    def finds(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """The calibrated probability of each span to be a secret."""
        return self.probability(self.span_logits([windows(text, a, b) for a, b in spans]))


def generated_findings(n: int = 1500, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of common formats in settings, code and prose, and long runs that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), int(k)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ["an", "er", "tion", "ou", "st", "re", "heit", "ment", "ión", "que", "ble", "ing", "sch", "eau", "ver", "lo", "ka", "mi"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(3, 9))))
    keys = [
        lambda: "ghp_" + pick(lower + upper + digits, 36), lambda: "sk_live_" + pick(lower + upper + digits, 24), lambda: "xoxb-" + pick(digits, 12) + "-" + pick(lower + upper + digits, 24),
        lambda: pick(lower + upper + digits + "+/", rng.integers(24, 64)) + "=", lambda: "eyJ" + pick(lower + upper + digits + "_-", rng.integers(40, 120)), lambda: pick(upper + digits, rng.integers(20, 40)),
        lambda: pick(lower + digits, rng.integers(24, 48)), lambda: "AIza" + pick(lower + upper + digits + "_-", 35),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(5)) + "-" + pick(digits, rng.integers(1, 4)), lambda: "/".join(word() for _ in range(4)) + "/" + word() + pick(digits, 2), lambda: pick("=-_", 1) * int(rng.integers(16, 40)) + pick(digits, 1),
        lambda: "20" + pick(digits, 2) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "T" + pick(digits, 6) + "-" + pick(digits, 4), lambda: pick(digits, rng.integers(16, 24)), lambda: "_".join(word() for _ in range(4)) + "_v" + pick(digits, 1),
        lambda: word() * 3 + word() + pick(digits, 1), lambda: pick("0" + pick(digits, 1), rng.integers(16, 30)),
    ]
    frames = ["{a} {b} {c}", '{a}\nkey = "{b}"\n{c}', "{a}: {b}, {c}", "export X={b}\n{c}", '{a} {{"id": "{b}"}} {c}', "{a} ({b}) {c}", "{b} {c}", "{a} {b}"]
    out = []
    for i in range(n):
        label = i % 2
        kinds = keys if label else plain
        value = kinds[int(rng.integers(len(kinds)))]()
        frame = str(rng.choice(frames))
        text = frame.format(a=prose(), b="\0", c=prose())
        start = text.index("\0")
        out.append((text.replace("\0", value), start, start + len(value), label))
    return out


def _sampled(docs: DataFrame, sample: int) -> list:
    """(windows, label) of labelled findings in the rows of `sample` doc_ids, whichever hash first, SAMPLE_FINDINGS at most.

    Labelled 1 are the rules' spans, 0 the runs that are plainly none; other runs have no label and take no part, as
    they may be secrets that the rules miss. Findings are cut out on the executors, so what comes to the
    driver is bounded, however often a doc_id is repeated and however long texts are.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(r"[A-Za-z0-9+/_=-]{10,}"))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                spans = base_spans(text)
                found = [(windows(text, s, e), 1) for s, _, e in spans]
                found += [(windows(text, s, e), 0) for s, e in candidates(text, spans) if plainly_none(text[s:e])]
                # at most 64 windows of a finding; all of them unless it has over 3,000 characters
                out += [(w[:64].astype(np.uint8).tobytes(), y) for w, y in found]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([y for _, y in out], pa.int32())], names=["windows", "label"])

    found = rows.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(cut, "windows binary, label int").distinct()
    return found.orderBy(F.xxhash64("windows"), "windows", "label").limit(SAMPLE_FINDINGS).collect()


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> CharCNN:
    """A network from generated findings and those of `sample` documents, with a threshold that a RECALL of held-out generated secrets, which no rule finds, reaches."""
    made = [(windows(t, a, b), y) for t, a, b, y in generated_findings()]
    kept = np.random.default_rng(1).random(len(made)) < 0.75
    found = [(np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW).astype(np.int64), r.label) for r in _sampled(docs, sample)]
    teach = [x for x, k in zip(made, kept, strict=True) if k] + found
    net = CharCNN().fit_spans([w for w, _ in teach], np.array([y for _, y in teach]))
    held = [x for x, k in zip(made, kept, strict=True) if not k]
    return net.calibrate(net.span_logits([w for w, _ in held]), np.array([y for _, y in held], float))


def _joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan_texts(texts, net: CharCNN | None) -> list[tuple[int, int, int, str, str, list[float]]]:
    """(n_assign, n_access, n_hex, base_sha256, spans, scores) of each text; null counts as empty. The network sees the spans of all texts together."""
    out, kinds, asked = [], (*KINDS, "model"), []
    for text in texts:
        base = base_spans(text or "")
        more = [(s, 3, e) for s, e in candidates(text, base)] if net is not None and text else []
        asked.append((base, more))
    p = np.zeros(0)
    if net is not None:
        p = net.probability(net.span_logits([windows(t, s, e) for t, (base, more) in zip(texts, asked, strict=True) for s, _, e in base + more]))
    at = 0
    for base, more in asked:
        both = base + more
        mine = p[at : at + len(both)] if net is not None else np.full(len(both), np.nan)
        at += len(both)
        kept = sorted((span, float(x)) for i, (span, x) in enumerate(zip(both, mine, strict=True)) if i < len(base) or x >= net.threshold)
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        out.append((*n, hashlib.sha256(_joined(base, kinds).encode()).hexdigest(), _joined([x for x, _ in kept], kinds), [x for _, x in kept]))
    return out


def secret_scan(docs: DataFrame, net: CharCNN | None = None) -> DataFrame:
    """Spans of secrets in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores.

    Spans are kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex,
    model). The network scores every candidate in its context, the rules' spans as well: scores has each span's
    probability. The rules' spans stay at any score; those of kind model are the others that reach the calibrated threshold. Candidates
    outside the rules are runs of ten or more key characters that are not words.

    Null and empty texts have none. Very long texts and candidates are scanned whole, in overlapping windows. Repeated rows
    are each scanned, with equal results. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(train(docs) if net is None else net)

    def apply(batches):
        for b in batches:
            found = list(zip(*scan_texts(b.column(1).to_pylist(), held.value), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in found[:3]), *(pa.array(x, pa.string()) for x in found[3:5]), pa.array(found[5], pa.list_(pa.float64()))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>"
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan(read(spark, sf_dir, "documents"))
