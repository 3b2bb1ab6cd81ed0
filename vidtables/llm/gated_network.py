"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window of WINDOW words goes through a gated recurrent unit in both directions; attention
pools the states, and a logistic unit scores the pool. A word's input joins an embedding of
the word with the mean embedding of its character n-grams (three bytes anywhere, and its
first four and five), both in hashed tables. ASCII marks at both ends of a word are left out.
"""

from __future__ import annotations

import numpy as np

from vidtables.llm.words import LOWER, U, Words, mix

WINDOW, STRIDE = 20, 10
WORDS, GRAMS = 1 << 14, 1 << 15  # sizes of the hashed tables
DIM, HIDDEN = 8, 8
HELD = 0.98  # of the averaged parameters at each step
RECALL = 1.5  # how much recall counts against precision for the cut
TOGETHER = 2048  # windows scored at once
CHUNK = 1 << 15  # distinct words whose n-grams are found at once
MARK = np.zeros(256, bool)  # ASCII that is neither letter nor digit
MARK[:128] = [not chr(c).isalnum() for c in range(128)]
F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Lexicon:
    """Distinct words of some texts: their place in the word table and their n-grams' in the gram table."""

    def __init__(self, w: Words):
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        start, n = self.bare(w.data, w.start[first], w.end[first] - w.start[first])
        parts = [self.grams(w.data, start[lo : lo + CHUNK], n[lo : lo + CHUNK]) for lo in range(0, len(n), CHUNK)]
        self.gram, self.count, self.word = (np.concatenate(x) if parts else np.zeros(0, np.int32) for x in (list(zip(*parts, strict=True)) or [()] * 3))
        self.first_gram = np.cumsum(self.count) - self.count

    @staticmethod
    def bare(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of words without marks at both ends; words of marks only stay."""
        start, end = start.copy(), start + n
        left = np.arange(len(n))
        while len(left := left[MARK[data[start[left]]]]):
            start[left] += 1
            left = left[start[left] < end[left]]
        right = np.flatnonzero(start < end)
        while len(right := right[MARK[data[end[right] - 1]]]):
            end[right] -= 1
        only = start == end
        return np.where(only, end - n, start), np.where(only, n, end - start)

    @staticmethod
    def grams(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams' places of some words, one word after the other, their number for each word, and the words' places."""
        at = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(at, n)
        b = LOWER[data[np.repeat(start, n) + place]].astype(np.uint64)
        of, size = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
        padded = np.concatenate((b, np.zeros(5, np.uint64)))
        m = len(b)
        three = padded[:m] << U(16) | np.where(place + 1 < size, padded[1 : m + 1], 0) << U(8) | np.where(place + 2 < size, padded[2 : m + 2], 0)
        whole = (place + 2 < size) | (place == 0)
        found, owner = [mix(three)[whole]], [of[whole]]
        for length in (4, 5):
            own = at[n >= length]
            x = np.full(len(own), length, np.uint64)
            for j in range(length):
                x = x << U(8) | padded[own + j]
            found.append(mix(x)), owner.append(np.flatnonzero(n >= length))
        owner = np.concatenate(owner)
        sums = np.concatenate(([U(0)], np.cumsum(mix(b + (place.astype(np.uint64) << U(8))))))
        word = (mix(sums[at + n] - sums[at] + n.astype(np.uint64)) % U(WORDS)).astype(np.int32)
        return (np.concatenate(found)[np.argsort(owner, kind="stable")] % U(GRAMS)).astype(np.int32), np.bincount(owner, minlength=len(n)), word


def windows(n: int) -> np.ndarray:
    """First words of all windows of a text of n words: every STRIDE words, and the last one."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Network:
    """The parameters, scoring and training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(F32)
        h = HIDDEN  # the tables begin near 0, so that words never learnt from hardly count
        self.p = {"word": normal(0.01, WORDS, DIM), "gram": normal(0.01, GRAMS, DIM), "v": normal(0.3, 2 * h), "w": normal(0.3, 2 * h), "b": np.zeros(1, F32)}
        for d in "fb":
            self.p |= {f"x{d}": normal(0.3, 2 * DIM, 3 * h), f"u{d}": normal(0.3, h, 3 * h), f"c{d}": np.zeros(3 * h, F32)}
        self.shift = 50.0  # until it has learnt, all scores are nearly 0

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """The input vector of each distinct word."""
        out = np.empty((len(lex.word), 2 * DIM), F32)
        out[:, :DIM] = self.p["word"][lex.word]
        if len(lex.word):
            for lo in range(0, len(out), CHUNK):
                some = slice(lex.first_gram[lo], lex.first_gram[lo + CHUNK] if lo + CHUNK < len(out) else None)
                sums = np.add.reduceat(self.p["gram"][lex.gram[some]], lex.first_gram[lo : lo + CHUNK] - lex.first_gram[lo])
                out[lo : lo + CHUNK, DIM:] = sums / lex.count[lo : lo + CHUNK, None]
        return out

    def logits(self, lex: Lexicon, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores of windows: at, the place in the text's words of each first word; n, their words, 1 at least."""
        x = self.inputs(lex)
        x = np.append(x, np.zeros((1, 2 * DIM), x.dtype), 0)  # the last stands for no word
        project = {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}
        out = np.empty(len(at), F32)
        step = np.arange(WINDOW)
        for lo in range(0, len(at), TOGETHER):
            a, m = at[lo : lo + TOGETHER], n[lo : lo + TOGETHER]
            inside = step < m[:, None]
            word = np.where(inside, lex.inverse[np.minimum(a[:, None] + step, len(lex.inverse) - 1)], len(x) - 1)
            full = bool(inside.all())
            states = np.empty((WINDOW, len(a), 2 * HIDDEN), F32)
            for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
                h = np.zeros((len(a), HIDDEN), F32)
                half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
                for t in order:
                    new = self.cell(project[d][word[:, t]], h, self.p[f"u{d}"])[0]
                    h = new if full else np.where(inside[:, t : t + 1], new, h)
                    states[t, :, half] = h
            e = states @ self.p["v"]
            if not full:
                e = np.where(inside.T, e, F32(-1e9))
            e = np.exp(e - e.max(0))
            pool = np.einsum("tn,tnh->nh", e / e.sum(0), states)
            out[lo : lo + TOGETHER] = pool @ self.p["w"] + self.p["b"]
        return out

    @staticmethod
    def cell(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step: the new state, then what training needs again."""
        k = HIDDEN
        hu = h @ u
        zr = sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
        z, r, inner = zr[:, :k], zr[:, k:], hu[:, 2 * k :]
        n = 2 * sigmoid(2 * (x[:, 2 * k :] + r * inner)) - 1
        return n + z * (h - n), z, r, n, inner

    def gradient(self, lex: Lexicon, at: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss over some windows."""
        k, p, B, T = HIDDEN, self.p, len(at), WINDOW
        inside = np.arange(T) < n[:, None]
        word = lex.inverse[np.minimum(at[:, None] + np.arange(T), len(lex.inverse) - 1)]
        used, word = np.unique(word, return_inverse=True)
        word = word.reshape(B, T)
        place = np.concatenate([np.arange(lex.first_gram[i], lex.first_gram[i] + lex.count[i]) for i in used])
        owner, gram = np.repeat(np.arange(len(used)), lex.count[used]), lex.gram[place]
        firsts, count = np.cumsum(lex.count[used]) - lex.count[used], lex.count[used][:, None]
        vec = np.concatenate((p["word"][lex.word[used]], np.add.reduceat(p["gram"][gram], firsts) / count), 1)
        states, tape = np.empty((T, B, 2 * k), F32), {}
        for d, order in (("f", range(T)), ("b", range(T - 1, -1, -1))):
            x = (vec @ p[f"x{d}"] + p[f"c{d}"])[word]
            h = np.zeros((B, k), F32)
            for t in order:
                new, *rest = self.cell(x[:, t], h, p[f"u{d}"])
                tape[d, t] = (h, *rest)
                h = np.where(inside[:, t : t + 1], new, h)
                states[t, :, slice(0, k) if d == "f" else slice(k, None)] = h
        e = np.where(inside.T, states @ p["v"], F32(-1e9))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pool = np.einsum("tn,tnh->nh", alpha, states)
        dl = ((sigmoid(pool @ p["w"] + p["b"]) - label) / B).astype(F32)
        g = {"w": pool.T @ dl, "b": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["w"]
        da = np.einsum("tnh,nh->tn", states, dpool)
        de = alpha * (da - (alpha * da).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, states)
        dstates = alpha[:, :, None] * dpool + de[:, :, None] * p["v"]
        dvec = np.zeros_like(vec)
        for d, order in (("f", range(T - 1, -1, -1)), ("b", range(T))):
            u, dh, du = p[f"u{d}"], np.zeros((B, k), F32), np.zeros((k, 3 * k), F32)
            dx = np.zeros((B, T, 3 * k), F32)
            for t in order:
                h, z, r, n_, inner = tape[d, t]
                dh = dh + dstates[t, :, slice(0, k) if d == "f" else slice(k, None)]
                own = inside[:, t : t + 1]
                new = dh * own
                dn = new * (1 - z) * (1 - n_ * n_)
                dz, dr = new * (h - n_) * z * (1 - z), dn * inner * r * (1 - r)
                dx[:, t] = np.concatenate((dz, dr, dn), 1)
                dhu = np.concatenate((dz, dr, dn * r), 1)
                du += h.T @ dhu
                dh = dh * ~own + new * z + dhu @ u.T
            g[f"u{d}"], g[f"c{d}"] = du, dx.sum((0, 1))
            per_word = np.zeros((len(used), 3 * k), F32)
            np.add.at(per_word, word.ravel(), dx.reshape(-1, 3 * k))
            g[f"x{d}"] = vec.T @ per_word
            dvec += per_word @ p[f"x{d}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], lex.word[used], dvec[:, :DIM])
        np.add.at(g["gram"], gram, (dvec[:, DIM:] / count)[owner])
        return g

    def fit(self, w: Words, labels: np.ndarray, parts: int = 3, **how: int) -> None:
        """Learns from whole labelled texts, given as one Words.

        The cut is not chosen by scores of texts that the network has learnt from: for each of `parts` parts of
        the texts a network learns from the others and scores it. The cut is the one with the highest F measure
        of these scores together, in which recall counts RECALL times, halfway between two neighbours; then a network learns from all texts.
        """
        lex, score = Lexicon(w), np.full(len(labels), -np.inf)
        n = np.diff(w.first)
        part = np.zeros(len(labels), np.int64)
        for y in (0, 1):
            part[labels == y] = np.random.default_rng(11).permutation(np.sum(labels == y)) % parts
        enough = min(np.sum(labels == 0), np.sum(labels == 1)) >= 2 * parts
        for k in range(parts if enough else 0):
            other = Network()
            other.learn(lex, w, labels, np.flatnonzero((n > 0) & (part != k)), **how)
            own = np.flatnonzero((n > 0) & (part == k))
            score[own] = other.best_windows(lex, w, own)
        texts = np.flatnonzero(n > 0)
        self.learn(lex, w, labels, texts, **how)
        if not enough:
            score[texts] = self.best_windows(lex, w, texts)
        self.shift = self.cut(score, labels)

    @staticmethod
    def cut(score: np.ndarray, labels: np.ndarray) -> float:
        """The score above which label 1 is said with the highest F measure; of equal ones the middle."""
        order = np.argsort(-score, kind="stable")
        hits = np.cumsum(labels[order])
        f = (1 + RECALL**2) * hits / (np.arange(len(order)) + 1 + RECALL**2 * labels.sum())
        f[:-1][score[order][:-1] == score[order][1:]] = -1  # no cut parts equal scores
        best = np.flatnonzero(f >= f.max() - 1e-12)
        k = int(best[len(best) // 2])
        edges = np.append(score[order], score[order[-1]] - 2)
        return float((edges[k] + edges[k + 1]) / 2) if np.isfinite(edges[k + 1]) else float(edges[k]) - 1

    def best_windows(self, lex: Lexicon, w: Words, texts: np.ndarray) -> np.ndarray:
        """The highest score of each text's windows; texts have words."""
        at, size, begin = self.windows_of(w, texts)
        return np.maximum.reduceat(self.logits(lex, at, size), begin) if len(texts) else np.zeros(0)

    @staticmethod
    def windows_of(w: Words, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of some texts that have words: first words, sizes, and each text's first window."""
        n = np.diff(w.first)[texts]
        starts = [windows(int(k)) + w.first[i] for i, k in zip(texts, n, strict=True)]
        counts = np.array(list(map(len, starts)), np.int64)
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return at, np.repeat(np.minimum(n, WINDOW), counts), np.cumsum(counts) - counts

    def learn(self, lex: Lexicon, w: Words, labels: np.ndarray, texts: np.ndarray, rounds: int = 3, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Learns from some of the texts.

        A text's label belongs to its most telling window: at first the one with the most telling
        word by smoothed log odds, in later rounds the one that the network scores highest. Texts
        of label 0 give one further window at random. The parameters are averaged over the steps.
        """
        rng = np.random.default_rng(seed)
        at, size, begin = self.windows_of(w, texts)
        of = np.repeat(np.arange(len(texts)), np.diff(np.append(begin, len(at))))
        y = labels[texts].astype(F32)
        odds = self.log_odds(lex, w.first, labels, texts)[lex.inverse]
        score = np.full(len(at), -99.0)
        for step in range(WINDOW):
            own = step < size
            score[own] = np.maximum(score[own], odds[at[own] + step])
        m1 = {k: np.zeros_like(x) for k, x in self.p.items()}
        m2 = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        average = {k: x.copy() for k, x in self.p.items()}
        for _ in range(rounds):
            order = np.lexsort((score, of))
            top = order[np.append(begin[1:], len(of)) - 1]
            for _ in range(epochs):
                clean = np.flatnonzero(y == 0)
                extra = begin[clean] + (rng.random(len(clean)) * np.diff(np.append(begin, len(of)))[clean]).astype(np.int64)
                chosen = rng.permutation(np.concatenate((top, extra)))
                for lo in range(0, len(chosen), batch):
                    c = chosen[lo : lo + batch]
                    step += 1
                    for k, g in self.gradient(lex, at[c], size[c], y[of[c]]).items():
                        m1[k] += F32(0.1) * (g - m1[k])
                        m2[k] += F32(0.01) * (g * g - m2[k])
                        self.p[k] -= F32(rate) * (m1[k] / F32(1 - 0.9**step)) / (np.sqrt(m2[k] / F32(1 - 0.99**step)) + F32(1e-6))
                    for k, x in self.p.items():
                        average[k] += F32(1 - min(HELD, step / (step + 5))) * (x - average[k])
            score = self.logits(lex, at, size)
        self.p = average

    @staticmethod
    def log_odds(lex: Lexicon, first: np.ndarray, labels: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """For each distinct word the highest log odds of label 1, by texts, of the word or one of its n-grams."""
        total = np.array([max(np.sum(labels[texts] == 0), 1), max(np.sum(labels[texts] == 1), 1)])
        words, grams = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
        for i, y in zip(texts, labels[texts], strict=True):
            own = np.unique(lex.inverse[first[i] : first[i + 1]])
            words[y, np.unique(lex.word[own])] += 1
            n = lex.count[own]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lex.first_gram[own], n)
            grams[y, np.unique(lex.gram[place])] += 1

        def odds(n: np.ndarray) -> np.ndarray:
            rate = (n + 0.5) / (total[:, None] + 1)
            return np.log(rate[1] / rate[0]) * (1 - np.exp(-n.sum(0) / 3))

        by_word, by_gram = odds(words)[lex.word], odds(grams)[lex.gram]
        return np.maximum(by_word, np.maximum.reduceat(by_gram, lex.first_gram)) if len(by_word) else by_word

    def score_texts(self, w: Words) -> np.ndarray:
        """The highest score of each text's overlapping windows, 0 to 1; texts without words get the pool of no state."""
        n = np.diff(w.first)
        out = np.full(len(n), float(self.p["b"][0]) - self.shift)
        texts = np.flatnonzero(n > 0)
        if len(texts):
            out[texts] = self.best_windows(Lexicon(w), w, texts) - self.shift
        return sigmoid(out)
