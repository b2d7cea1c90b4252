"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Layout: features by sequences, so that every step works on contiguous rows. A text is cut into windows of WINDOW bytes that
run side by side; every byte of every window gets a distribution over the languages, and a document's is their mean.
"""

from __future__ import annotations

import numpy as np

WINDOW = 64


class Gru:
    """Parameters: per direction an input table e (256, 3H) and a recurrent matrix u (H, 3H); output v (2H, L) and c (L,)."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.w = {"v": draw(2 * hidden, len(languages), scale=0.3), "c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.w |= {f"e{d}": draw(256, 3 * hidden, scale=0.4), f"u{d}": draw(hidden, 3 * hidden, scale=0.3)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) of direction d over bytes x (T, B), in the order of x. keep: gets what the way back needs."""
        h_, (steps, b) = self.h, x.shape
        e, u = self.w[f"e{d}"], np.ascontiguousarray(self.w[f"u{d}"].T)
        h, out = np.zeros((h_, b), np.float32), np.empty((steps, h_, b), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.ascontiguousarray(e.take(x[t], axis=0).T)
            g = u @ h
            gates = a[: 2 * h_]
            gates += g[: 2 * h_]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:h_], gates[h_:]
            n = r * g[2 * h_ :]
            n += a[2 * h_ :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, z, r, n, g[2 * h_ :]))
            new = h - n
            new *= z
            new += n
            h = out[t] = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, L, B) of the languages at every byte."""
        states = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=1)
        return self._softmax(states)

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        p = np.ascontiguousarray(self.w["v"].T) @ states + self.w["c"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that count, and its gradients; x and mask (T, B), y (B,)."""
        kept = {"f": [], "b": []}
        states = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=1)
        p = self._softmax(states)
        own = p[:, y, np.arange(len(y))]
        weight = (mask / mask.sum()).astype(np.float32)
        loss = float(-(np.log(np.maximum(own, 1e-9)) * weight).sum())
        p[:, y, np.arange(len(y))] -= 1
        p *= weight[:, None, :]
        grads = {"v": np.einsum("tsb,tlb->sl", states, p), "c": p.sum(axis=(0, 2))}
        back = np.einsum("sl,tlb->tsb", self.w["v"], p)
        for k, d in enumerate("fb"):
            grads |= self._back(x, d, kept[d], back[:, k * self.h : (k + 1) * self.h])
        return loss, grads

    def _back(self, x: np.ndarray, d: str, kept: list, out: np.ndarray) -> dict[str, np.ndarray]:
        h_, u = self.h, self.w[f"u{d}"]
        du, da = np.zeros_like(u), np.empty((len(x), 3 * h_, x.shape[1]), np.float32)
        dh = np.zeros_like(out[0])
        for t, h, z, r, n, g in reversed(kept):
            dh = dh + out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
            dr = dn * g * 0.25 * ((r > 0) & (r < 1))
            da[t] = np.concatenate([dz, dr, dn])
            dg = np.concatenate([dz, dr, dn * r])
            du += h @ dg.T
            dh = dh * z + u @ dg
        de = np.zeros_like(self.w[f"e{d}"])
        np.add.at(de, x.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * h_))
        return {f"e{d}": de, f"u{d}": du}

    def train(self, windows: list[bytes], labels: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.02, seed: int = 4) -> float:
        """Adam over random batches, each language as likely as any other; the last loss."""
        x, mask = padded(windows)
        rng, loss = np.random.default_rng(seed), 0.0
        groups = [np.nonzero(labels == k)[0] for k in range(len(self.languages))]
        groups = [g for g in groups if len(g)]
        m = {k: np.zeros_like(w) for k, w in self.w.items()}
        s = {k: np.zeros_like(w) for k, w in self.w.items()}
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(groups[i]) for i in rng.integers(0, len(groups), batch)])
            loss, grads = self.gradients(x[:, pick], labels[pick], mask[:, pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1, 20 * (1 - (step - 1) / steps) / 20)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes], side: int = 2048) -> np.ndarray:
        """Mean probabilities (documents, L) over every byte of each text; an empty text gives zeros."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        if sizes.sum():
            data = np.frombuffer(b"".join(texts) + bytes(WINDOW), dtype=np.uint8)
            many = -(-sizes // WINDOW)
            doc = np.repeat(np.arange(len(texts)), many)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start, left = (np.cumsum(sizes) - sizes)[doc] + at * WINDOW, np.minimum(WINDOW, sizes[doc] - at * WINDOW)
            for i in range(0, len(doc), side):
                place = start[i : i + side] + np.arange(WINDOW)[:, None]
                ok = np.arange(WINDOW)[:, None] < left[i : i + side]
                p = self.positions(np.where(ok, data[np.minimum(place, len(data) - 1)], 0))
                summed = np.einsum("tlb,tb->bl", p, ok.astype(np.float32))
                np.add.at(total, doc[i : i + side], summed)
        return total / np.maximum(sizes, 1)[:, None]


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((WINDOW, len(windows)), np.uint8)
    mask = np.zeros((WINDOW, len(windows)), np.float32)
    for k, w in enumerate(windows):
        x[: len(w), k], mask[: len(w), k] = np.frombuffer(w, np.uint8), 1
    return x, mask
