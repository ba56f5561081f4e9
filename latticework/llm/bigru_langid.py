"""Language ID by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import free_name

#: Bytes of a window, which the network reads both ways from a zero state; hidden units.
WINDOW, HIDDEN = 64, 8
#: Bound of the training sample: documents, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 8
EPOCHS, BATCH, RATE, SEED = 8, 256, 0.01, 7
#: Windows that go through the network at once.
AT_ONCE = 1024
#: Windows of a stretch of texts, about; a longer text is a stretch of its own.
STRETCH = 16 * AT_ONCE
UNDETERMINED = "und"
#: Documents that score less are rejected by accepted().
LEAST_SCORE = 0.3


@dataclass
class BiGru:
    """For each direction: x (3h, 256) inputs by byte, u (3h, h) recurrence, c (h, 1) the
    candidate's recurrent bias; gates in the order update, reset, candidate. Then the output
    layer v (classes, 2h) and b. Windows run along the last axis, so each step is whole-array
    arithmetic."""

    langs: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> BiGru:
        rng = np.random.default_rng(seed)
        make = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        p = {}
        for d in "fb":
            p |= {f"x{d}": make(3 * hidden, 256, s=0.3), f"u{d}": make(3 * hidden, hidden, s=hidden**-0.5), f"c{d}": np.zeros((hidden, 1), np.float32)}
        p |= {"v": make(len(langs), 2 * hidden, s=hidden**-0.5), "b": np.zeros((len(langs), 1), np.float32)}
        return cls(langs, p)

    def run(self, d: str, steps: np.ndarray, sizes: np.ndarray, trace: bool = False):
        """States (time, h, window) of one direction; with trace also what gradients() needs.
        steps: the windows' bytes (time, window); beyond a window's size its state is zero. The logistic function is (1 + tanh(x/2)) / 2;
        the halves are in the weights."""
        x, u, c = (self.p[k + d] * np.float32(0.5) for k in "xuc")
        h = u.shape[1]
        x[2 * h :] *= 2
        n = steps.shape[1]
        states, kept, least = np.empty((len(steps), h, n), np.float32), [], sizes.min(initial=len(steps))
        s, g, a, w = (np.zeros((k, n), np.float32) for k in (h, 3 * h, 3 * h, h))
        for t in range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1):
            np.take(x, steps[t], axis=1, out=g, mode="clip")
            np.matmul(u, s, out=a)
            gates, m, inner = g[: 2 * h], g[2 * h :], a[2 * h :]
            gates += a[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            inner += c
            np.multiply(gates[h:], inner, out=w)
            m += w
            np.tanh(m, out=m)
            if trace:
                kept.append((t, s.copy(), gates[:h] / 2, gates[h:] / 2, m.copy(), inner * 2))
            np.subtract(s, m, out=w)
            w *= gates[:h]
            w *= 0.5
            s = np.add(w, m, out=states[t])
            if t >= least:
                s[:, sizes <= t] = 0
        return (states, kept) if trace else states

    def position_scores(self, forward: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Probabilities (time, class, window)."""
        h = forward.shape[1]
        y = np.matmul(self.p["v"][:, :h], forward)
        y += np.matmul(self.p["v"][:, h:], back)
        y += self.p["b"]
        if np.abs(self.p["v"]).sum(axis=1).max() + np.abs(self.p["b"]).max() > 60:  # else states under 1 can't overflow
            y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, windows: np.ndarray, sizes: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time. Every position of a window,
        up to its size, is labelled with the window's language."""
        h = self.p["uf"].shape[1]
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        (hf, tf), (hb, tb) = self.run("f", steps, sizes, True), self.run("b", steps, sizes, True)
        y = self.position_scores(hf, hb)
        t, _, n = y.shape
        mask = (np.arange(t)[:, None] < sizes[None, :]) * weights[None, :]
        mask = (mask / mask.sum()).astype(np.float32)
        own = np.arange(n)
        loss = float(-(mask * np.log(np.maximum(y[:, targets, own], 1e-9))).sum())
        y[:, targets, own] -= 1
        y *= mask[:, None, :]
        both = np.concatenate((hf, hb), axis=1)
        g = {"b": y.sum(axis=(0, 2))[:, None], "v": np.matmul(y, both.transpose(0, 2, 1)).sum(axis=0)}
        for d, kept, v in (("f", tf, self.p["v"][:, :h]), ("b", tb, self.p["v"][:, h:])):
            u, out = self.p[f"u{d}"], np.matmul(v.T, y)
            gx, gu, gc = (np.zeros_like(self.p[k + d]) for k in "xuc")
            ds, one = np.zeros((h, n), np.float32), np.zeros((n, 256), np.float32)
            for k, s, z, r, m, inner in reversed(kept):
                ds = ds + out[k]
                ds[:, sizes <= k] = 0
                dm = ds * (1 - z) * (1 - m * m)
                dz = ds * (s - m) * z * (1 - z)
                dr = dm * inner * r * (1 - r)
                di = dm * r
                da = np.concatenate((dz, dr, di))
                gc += di.sum(axis=1, keepdims=True)
                gu += da @ s.T
                one[own, steps[k]] = 1
                gx += np.concatenate((dz, dr, dm)) @ one
                one[own, steps[k]] = 0
                ds = ds * z + u.T @ da
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, g

    def fit(self, windows: np.ndarray, sizes: np.ndarray, targets: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam, its rate falling to a tenth; classes weigh alike. Returns each epoch's loss."""
        rng, losses = np.random.default_rng(seed), []
        share = np.bincount(targets, minlength=len(self.langs)) / len(targets)
        weights = 1 / np.maximum(share, 0.02)[targets]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(targets) // batch)
        for _ in range(epochs):
            order, loss = rng.permutation(len(targets)), 0.0
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                now, g = self.gradients(windows[i], sizes[i], targets[i], weights[i])
                loss += now * len(i) / len(order)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x / max(1.0, norm)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    go = rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - go).astype(np.float32)
            losses.append(loss)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Each document's probabilities, pooled as the mean over all its bytes; a stretch of texts
        at a time, so that memory doesn't grow with the batch."""
        part = np.cumsum([-(-len(x) // WINDOW) for x in texts]) // STRETCH
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return np.concatenate([self.stretch(texts[a:b]) for a, b in zip(bounds, bounds[1:])])

    def stretch(self, texts: list[bytes]) -> np.ndarray:
        """documents() of texts that are held in memory together."""
        counts = np.array([-(-len(x) // WINDOW) for x in texts])
        windows, sizes = windowed(texts)
        sums = np.zeros((len(windows) + 1, len(self.langs)))
        for at in range(0, len(windows), AT_ONCE):
            w, s = windows[at : at + AT_ONCE], sizes[at : at + AT_ONCE]
            steps = np.ascontiguousarray(w.T).astype(np.intp)
            y = self.position_scores(self.run("f", steps, s), self.run("b", steps, s))
            if (s < WINDOW).any():
                y *= (np.arange(WINDOW)[:, None] < s[None, :])[:, None, :]
            sums[at : at + len(w)] = y.sum(axis=0).T
        ends = np.cumsum(counts)
        total = np.concatenate((np.zeros((1, sums.shape[1])), np.cumsum(sums[:-1], axis=0)))
        pooled = total[ends] - total[ends - counts]
        return pooled / np.maximum(1, [len(x) for x in texts])[:, None]


def windowed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts in turn, the last of each filled up with zeros; their sizes."""
    data = b"".join([x + bytes(-len(x) % WINDOW) for x in texts])
    windows = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
    sizes = np.full(len(windows), WINDOW)
    ends = np.cumsum([-(-len(x) // WINDOW) for x in texts])
    for x, end in zip(texts, ends):
        if len(x) % WINDOW:
            sizes[end - 1] = len(x) % WINDOW
    return windows, sizes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> BiGru | None:
    """A network fitted on at most `sample_docs` labelled documents outside the held-out fold,
    SAMPLE_WINDOWS windows of each. Each language has a quota of documents (see quotas()), those
    whose ids hash lowest. None if there are none."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("id")))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).where("n > 0").orderBy(F.desc("n"), "lang").limit(sample_docs)
    sizes = {r.lang: r.n for r in counted.collect()}  # sample_docs rows at most
    if not sizes:
        return None
    # Hashes under a share somewhat above the quota's are few, and hold it but for odd chance.
    wanted = [(lang, q, min(1.0, (1.2 * q + 4 * q**0.5 + 16) / sizes[lang])) for lang, q in quotas(sizes, sample_docs).items()]
    drawing = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, quota int, share double"))
    hashed = rows.select("id", "lang", F.xxhash64("id", F.lit(SEED)).alias("h")).where("id is not null")
    some_ids = hashed.join(drawing, "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share")).select("id", "lang", "h", "quota").distinct()
    ids = some_ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where("k <= quota").select("id", "lang")
    chosen = rows.join(F.broadcast(ids), ["id", "lang"], "left_semi")  # sample_docs ids at most

    def some(parts):
        for part in parts:
            out = []
            for text, lang in zip(part.text, part.lang):
                windows, sizes = windowed([text.encode()])
                rng = np.random.default_rng(len(text))
                for k in rng.permutation(len(windows))[:SAMPLE_WINDOWS]:
                    out.append((lang, windows[k].tobytes(), int(sizes[k])))
            yield pd.DataFrame(out, columns=["lang", "window", "size"])

    drawn = chosen.mapInPandas(some, "lang string, window binary, size int").orderBy(F.xxhash64("window"), "lang", "window", "size").limit(sample_docs * SAMPLE_WINDOWS)
    found = drawn.toPandas().sort_values(["lang", "window", "size"])
    if found.empty:
        return None
    langs = sorted(set(found.lang))
    windows = np.frombuffer(b"".join(found.window), np.uint8).reshape(-1, WINDOW)
    net = BiGru.new(langs)
    net.fit(windows, found["size"].to_numpy(), np.searchsorted(langs, found.lang))
    return net


def quotas(sizes: dict[str, int], docs: int) -> dict[str, int]:
    """How many documents to draw of each language, `docs` in all at most: a quarter is dealt
    out evenly, the rest in proportion; never more than there are."""
    even = max(1, docs // (4 * len(sizes)))
    least = {lang: min(n, even) for lang, n in sizes.items()}
    left, rest = docs - sum(least.values()), sum(sizes.values()) - sum(least.values())
    return {lang: least[lang] + min(n - least[lang], left * (n - least[lang]) // max(rest, 1)) for lang, n in sizes.items()}


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: BiGru | None = None) -> DataFrame:
    """One row for each row of docs: (doc_id, held_out, lang_pred, score).

    The network labels every byte of the whole text; the mean of its probabilities over all
    bytes is the document's. lang_pred is the likeliest language, the first by name of equal
    ones, and score its probability. Null and empty texts, and texts without a letter, get
    `und` and score 0, and so do all if no document could be learned from. Repeated rows and
    null ids are returned as they are; an empty table gives an empty result; other columns are
    ignored. `net`: a network trained before; else one is trained on docs.
    """
    net = net or train(docs, id_col, text_col, lang_col)
    found = predictor(net)(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


def predictor(net: BiGru | None):
    """A UDF: text -> (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(text), UNDETERMINED, object), np.zeros(len(text))
        at = [i for i, x in enumerate(text) if isinstance(x, str) and any(map(str.isalpha, x))]
        if net and at:
            y = net.documents([text.iloc[i].encode() for i in at])
            best = y.argmax(axis=1)
            lang[at], score[at] = np.array(net.langs, object)[best], np.clip(y[np.arange(len(at)), best], 0, 1)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def accepted(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, all columns kept, without the documents whose language can't be told: those with
    `und` (null or empty text, no letter), and those that score under `least`. If no document
    could be learned from, only those without a letter go."""
    net = train(docs, id_col, text_col, lang_col)
    found = free_name(docs.columns, "_found")
    judged = docs.withColumn(found, predictor(net)(F.col(text_col)))
    keeps = (F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= least) if net else F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return judged.where(keeps).select(*[F.col(f"`{c}`") for c in docs.columns])
