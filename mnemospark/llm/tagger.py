"""A character-level bidirectional LSTM with CRF transitions: decoding in ONNX Runtime or else numpy, training in numpy."""

from __future__ import annotations

import unicodedata
from pathlib import Path

import numpy as np

from .recurrent import runner

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ("O", *KINDS)
K = len(LABELS)

# Characters with an entry of their own; digits share one, all others share one for each class.
_OWN = "\n !\"#&'()*+,-./:;<=>?@[]_{}|~’ªº°" + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CLASSES = ("pad", "digit", "upper", "lower", "space", "mark", "other")
VOCAB = len(_CLASSES) + len(_OWN)

#: Characters of a window, and how many of them it shares with the next.
WINDOW, OVERLAP = 288, 96

#: Windows that are scored together: what a step reads and writes for them fits a core's cache.
BATCH = 512


def _table() -> np.ndarray:
    out = np.zeros(0x10000 + 1, np.uint8)
    kind = {"Nd": 1, "Lu": 2, "Lt": 2, "Ll": 3, "Lo": 3, "Lm": 3, "Zs": 4, "Zl": 4, "Zp": 4, "Cc": 4}
    for c in range(0x10000):
        cat = unicodedata.category(chr(c))
        out[c] = kind.get(cat, 5 if cat[0] in "PSM" else 6)
    out[0x10000] = 6
    for i, c in enumerate(_OWN):
        out[ord(c)] = len(_CLASSES) + i
    return out


CHARS = _table()


def char_ids(text: str) -> np.ndarray:
    """One small number for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CHARS[np.minimum(codes, 0x10000)]


class Tagger:
    """Parameters: for each direction an input table (VOCAB, 4h), recurrent weights (h, 4h), and output (h, K); bias and transitions.

    Gates stand in the order input, forget, output, candidate.
    """

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in params.items()}
        self.h = self.p["rf"].shape[0]
        self.runners: dict = {}
        # sigmoid(x) = (tanh(x / 2) + 1) / 2, so one tanh does for all gates; the hidden state is kept doubled. Each gate has a
        # table and a matrix of its own, so that its values for all rows stand next to each other.
        half = np.concatenate([np.full(3 * self.h, 0.5), np.ones(self.h)]).astype(np.float32)
        self.fast = {n: np.ascontiguousarray((self.p[n] * half * (0.5 if n[0] == "r" else 1)).reshape(-1, 4, self.h).swapaxes(0, 1), np.float32) for n in ("xf", "xb", "rf", "rb")}
        self.fast |= {n: self.p[n] * np.float32(0.5) for n in ("of", "ob")}
        # over O, a run of other labels gains a way in, a way out and its inner steps, and loses O's lead at each place; at
        # the ends of a text the way in or out is a start or an end
        t = self.p["trans"].astype(float) - float(self.p["trans"][0, 0])
        self.inner = float(t[1:, 1:].max())
        self.way_in, self.way_out = float(t[0, 1:].max()), float(t[1:, 0].max())
        self.at_start, self.at_end = float(self.p["start"][1:].max() - self.p["start"][0]), float(self.p["end"][1:].max() - self.p["end"][0])

    @classmethod
    def fresh(cls, h: int, seed: int = 0) -> "Tagger":
        """Random weights."""
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.1, (VOCAB, 4 * h))
            p["x" + d][:, h : 2 * h] += 1.0
            p["r" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) * 0.5
            p["o" + d] = rng.normal(0, 1 / np.sqrt(h), (h, K))
        p |= {"bias": np.zeros(K), "trans": np.zeros((K, K)), "start": np.zeros(K), "end": np.zeros(K)}
        return cls(p)

    @classmethod
    def load(cls, path: str | Path) -> "Tagger":
        """From an .npz file."""
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def save(self, path: str | Path) -> None:
        """To an .npz file of half precision."""
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _run(self, ids: np.ndarray, pos: np.ndarray, active: list[int], d: str) -> np.ndarray:
        """The direction's part of the scores of some sequences, step by step: first of all that are live at the first step.

        Sequences begin at the places pos of ids and go on to the right (f) or left (b); the first active[t] are live at step t.
        """
        h, table, rec, by = self.h, self.fast["x" + d], self.fast["r" + d], 1 if d == "f" else -1
        n = len(pos)
        hidden, cells = np.empty((sum(active), h), np.float32), np.zeros((n, h), np.float32)
        gates, sums = np.empty(4 * n * h, np.float32), np.empty(4 * n * h, np.float32)
        one, half, at, m = np.float32(1), np.float32(0.5), 0, -1
        for t, live in enumerate(active):
            if live != m:
                m = live
                g, s = gates[: 4 * m * h].reshape(4, m, h), sums[: 4 * m * h].reshape(4, m, h)
                cell, sigmoids, (i, f, o, new), a = cells[:m], g[:3], g, s[0]
            np.take(table, ids.take(pos[:m] + by * t), axis=1, out=g, mode="clip")
            if t:
                np.matmul(hid[:m], rec, out=s)
                np.add(g, s, out=g)
            np.tanh(g, out=g)
            np.add(sigmoids, one, out=sigmoids)
            np.multiply(cell, f, out=cell)
            np.multiply(i, new, out=a)
            np.add(cell, a, out=cell)
            np.multiply(cell, half, out=cell)
            np.tanh(cell, out=a)
            hid = hidden[at : at + m]
            np.multiply(o, a, out=hid)
            at += m
        return hidden @ self.fast["o" + d]

    def _runner(self, d: str):
        """The direction in ONNX Runtime, or None."""
        if d not in self.runners:
            self.runners[d] = runner(self.p["x" + d], self.p["r" + d], self.p["o" + d])
        return self.runners[d]

    def _side(self, ids: np.ndarray, first: np.ndarray, steps: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The direction's scores of all sequences; where its step t stands: at places[begin + t] + rank."""
        run = self._runner(d)
        order = np.argsort(-steps, kind="stable")[: np.count_nonzero(steps)]
        begin, rank, done, known = np.zeros(len(steps), np.intp), np.zeros(len(steps), np.intp), 0, 0
        scores, places = [np.zeros((0, K), np.float32)], [np.zeros(0, np.intp)]
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            top = int(steps[rows[0]])
            if run:  # all rows to the last step; beyond a row's own end nothing is read from it
                active = np.full(top, len(rows))
                where = first[rows] + (1 if d == "f" else -1) * np.arange(top)[:, None]
                scores.append(run(ids.take(where, mode="clip")).reshape(-1, K))
            else:
                active = len(rows) - np.searchsorted(steps[rows][::-1], np.arange(top), side="right")
                scores.append(self._run(ids, first[rows], active.tolist(), d))
            begin[rows], rank[rows] = known, np.arange(len(rows))
            places.append(done + np.cumsum(active) - active)
            done, known = done + len(scores[-1]), known + top
        return np.concatenate(scores), np.concatenate(places), begin, rank

    def _scores(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(places, K) scores of the places low to high of each window, one window after the other.

        A window is size characters of ids from start; neither direction goes on past the last place that is asked for.
        """
        kept = high - low
        step = np.arange(int(kept.sum())) + np.repeat(low - (np.cumsum(kept) - kept), kept)
        scores, places, begin, rank = self._side(ids, start, high, "f")
        out = scores.take(places.take(step + np.repeat(begin, kept)) + np.repeat(rank, kept), axis=0)
        scores, places, begin, rank = self._side(ids, start + size - 1, size - low, "b")
        out += scores.take(places.take(np.repeat(begin + size - 1, kept) - step) + np.repeat(rank, kept), axis=0)
        out += self.p["bias"]
        return out

    def emissions(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """(length, K) scores for each window of character ids."""
        if not windows:
            return []
        size = np.array([len(w) for w in windows], np.intp)
        stop = np.cumsum(size)
        scores = self._scores(np.concatenate(windows).astype(np.int32), stop - size, size, np.zeros_like(size), size)
        return [scores[b - n : b] for b, n in zip(stop.tolist(), size.tolist())]

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best path over each whole text, from its (length, K) scores."""
        out = [np.zeros(len(e), np.int8) for e in scores]
        some = [i for i, e in enumerate(scores) if len(e)]
        if not some:
            return out
        flat = np.concatenate([scores[i] for i in some]).T
        rival = flat[1]
        for k in range(2, K):
            rival = np.maximum(rival, flat[k])
        begin = np.concatenate([[0], np.cumsum([len(scores[i]) for i in some])[:-1]])
        # the best run of each text is a largest sum of successive places; a fall at each text's begin parts the texts
        gain = (self.inner - (flat[0] - rival)).astype(np.float64)
        stop = np.append(begin[1:], len(gain))
        plain = np.concatenate([[0.0], np.cumsum(gain)])
        base = np.repeat(plain[begin], stop - begin)
        head, tail = np.maximum.reduceat(plain[1:] - base, begin), plain[stop] - np.minimum.reduceat(plain[:-1], begin)
        falls = np.zeros(len(gain))
        falls[begin] = -1e7
        upto = np.cumsum(gain + falls)
        floor = np.minimum.accumulate(np.concatenate([[0.0], upto[:-1]]) + falls)
        inside = np.maximum.reduceat(upto - floor, begin)
        best = np.max([inside + self.way_in + self.way_out, head + self.at_start + self.way_out, tail + self.way_in + self.at_end, plain[stop] - plain[begin] + self.at_start + self.at_end], axis=0)
        hard = [some[j] for j in np.flatnonzero(best - self.inner > -1e-3).tolist()]
        hard.sort(key=lambda i: -len(scores[i]))
        trans = np.ascontiguousarray(self.p["trans"])  # from, to
        for at in range(0, len(hard), 256):
            rows = hard[at : at + 256]
            lengths = np.array([len(scores[i]) for i in rows])
            top, n = int(lengths[0]), len(rows)
            e = np.zeros((n, top, K), np.float32)
            for r, i in enumerate(rows):
                e[r, : lengths[r]] = scores[i]
            e = np.ascontiguousarray(e.transpose(1, 2, 0))
            active = (lengths[None, :] > np.arange(top)[:, None]).sum(1).tolist()
            best = np.empty((top, K, n), np.float32)
            best[0] = self.p["start"][:, None] + e[0]
            for t in range(1, top):
                m = active[t]
                best[t] = best[t - 1]
                x = (best[t - 1][:, None, :m] + trans[:, :, None]).max(0)
                np.add(x, e[t, :, :m], out=best[t, :, :m])
            k = (best[-1] + self.p["end"][:, None]).argmax(0)
            path = np.zeros((top, n), np.int8)
            for t in range(top - 1, 0, -1):
                m = active[t]
                path[t, :m] = k[:m]
                k[:m] = (best[t - 1][:, :m] + trans[:, k[:m]]).argmax(0)
            path[0] = k
            for r, i in enumerate(rows):
                out[i] = path[: lengths[r], r].copy()
        return out

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The label of every character of every text, whole texts.

        Long texts are scored in overlapping windows; of two windows the one in which a character stands further inside
        gives its scores, and the path is decoded over the whole text.
        """
        ids, size = char_ids("".join(texts)).astype(np.int32), np.array([len(t) for t in texts], np.intp)
        stop = np.cumsum(size)
        count = 1 + np.maximum(0, -(-(size - WINDOW) // (WINDOW - OVERLAP)))
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = nth * (WINDOW - OVERLAP)
        width = np.minimum(WINDOW, size[owner] - at)
        low = np.where(nth > 0, OVERLAP // 2, 0)
        high = np.where(nth < count[owner] - 1, WINDOW - OVERLAP // 2, width)
        scores = self._scores(ids, (stop - size)[owner] + at, width, low, high)
        return self.decode([scores[b - n : b] for b, n in zip(stop.tolist(), size.tolist())])


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, label) of the runs that aren't O."""
    edge = np.flatnonzero(np.diff(labels, prepend=0, append=0) != 0)
    cuts = sorted({0, len(labels), *edge.tolist()})
    return [(a, b, int(labels[a])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a and labels[a]]


# ---- training ----


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(p: dict, e: np.ndarray, y: np.ndarray, mask: np.ndarray):
    """Negative log-likelihood of a batch and its gradients; e (T, B, K), y and mask (T, B)."""
    t_max, b, _ = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = p["start"] + e[0]
    for t in range(1, t_max):
        a = _logsumexp(alpha[t - 1][:, :, None] + p["trans"][None], 1) + e[t]
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    logz = _logsumexp(alpha[-1] + p["end"], 1)
    beta[-1] = p["end"]
    d_trans = np.zeros((K, K))
    for t in range(t_max - 2, -1, -1):
        nxt = e[t + 1] + beta[t + 1]
        x = _logsumexp(p["trans"][None] + nxt[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], x, beta[t + 1])
        pair = np.exp(alpha[t][:, :, None] + p["trans"][None] + nxt[:, None, :] - logz[:, None, None])
        d_trans += (pair * mask[t + 1][:, None, None]).sum(0)
    post = np.exp(alpha + beta - logz[None, :, None]) * mask[:, :, None]
    gold = np.eye(K, dtype=np.float32)[y] * mask[:, :, None]
    d_e = post - gold
    last = mask.sum(0).astype(int) - 1
    rows = np.arange(b)
    score = (e * gold).sum() + p["start"][y[0]].sum() + p["end"][y[last, rows]].sum()
    both = mask[1:]
    np.subtract.at(d_trans, (y[:-1][both], y[1:][both]), 1)
    score += p["trans"][y[:-1][both], y[1:][both]].sum()
    d_start = d_e[0].sum(0)
    d_end = np.exp(alpha[-1] + p["end"] - logz[:, None]).sum(0) - np.bincount(y[last, rows], minlength=K)
    return float(logz.sum() - score), d_e, d_trans, d_start, d_end


def _lstm_forward(table, rec, ids, h):
    t_max, b = ids.shape
    hs, cs, gs = np.zeros((t_max + 1, b, h), np.float32), np.zeros((t_max + 1, b, h), np.float32), np.zeros((t_max, b, 4 * h), np.float32)
    for t in range(t_max):
        g = table[ids[t]] + hs[t] @ rec
        g[:, : 3 * h] = 0.5 * np.tanh(0.5 * g[:, : 3 * h]) + 0.5
        g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
        gs[t] = g
        cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
        hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
    return hs, cs, gs


def _lstm_backward(rec, ids, h, hs, cs, gs, d_h):
    t_max, b = ids.shape
    dg_all = np.zeros((t_max, b, 4 * h), np.float32)
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    rt = np.ascontiguousarray(rec.T)
    for t in range(t_max - 1, -1, -1):
        i, f, o, u = (gs[t][:, k * h : (k + 1) * h] for k in range(4))
        dh = dh + d_h[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dg = dg_all[t]
        dg[:, :h] = dc * u * i * (1 - i)
        dg[:, h : 2 * h] = dc * cs[t] * f * (1 - f)
        dg[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dg[:, 3 * h :] = dc * i * (1 - u * u)
        dc = dc * f
        dh = dg @ rt
    flat = dg_all.reshape(-1, 4 * h)
    one_hot = np.zeros((VOCAB, len(flat)), np.float32)
    one_hot[ids.ravel(), np.arange(len(flat))] = 1
    return one_hot @ flat, hs[:-1].reshape(-1, h).T @ flat


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray, lengths: np.ndarray, drop: np.ndarray | None = None):
    """Loss and gradients of a batch; ids and y are (T, B), padded at the end. ``drop`` scales the hidden units (2, h)."""
    h = p["rf"].shape[0]
    t_max, b = ids.shape
    mask = np.arange(t_max)[:, None] < lengths[None, :]
    back = np.where(mask, lengths[None, :] - 1 - np.arange(t_max)[:, None], np.arange(t_max)[:, None])
    cols = np.arange(b)[None, :]
    ids_b = ids[back, cols]
    f, r = _lstm_forward(p["xf"], p["rf"], ids, h), _lstm_forward(p["xb"], p["rb"], ids_b, h)
    hf, hb = f[0][1:], r[0][1:][back, cols]
    if drop is not None:
        hf, hb = hf * drop[0], hb * drop[1]
    e = hf @ p["of"] + hb @ p["ob"] + p["bias"]
    loss, d_e, d_trans, d_start, d_end = _crf(p, e.astype(np.float64), y, mask)
    d_e = d_e.astype(np.float32)
    flat = d_e.reshape(-1, K)
    g = {"of": hf.reshape(-1, h).T @ flat, "ob": hb.reshape(-1, h).T @ flat, "bias": flat.sum(0), "trans": d_trans, "start": d_start, "end": d_end}
    d_hf, d_hb = d_e @ p["of"].T, d_e @ p["ob"].T
    if drop is not None:
        d_hf, d_hb = d_hf * drop[0], d_hb * drop[1]
    g["xf"], g["rf"] = _lstm_backward(p["rf"], ids, h, *f, d_hf)
    g["xb"], g["rb"] = _lstm_backward(p["rb"], ids_b, h, *r, d_hb[back, cols])
    return loss, g


def train(samples: list[tuple[str, np.ndarray]], h: int = 24, epochs: int = 12, batch: int = 192, rate: float = 8e-3, seed: int = 0, start: Tagger | None = None, seconds: float = 1e9, say=print) -> Tagger:
    """Fit a tagger to (text, label of each character) with Adam; texts longer than a window are cut."""
    import time

    rng = np.random.default_rng(seed)
    p = {k: v.astype(np.float32) for k, v in (start or Tagger.fresh(h, seed)).p.items()}
    h = p["rf"].shape[0]
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    data = [(char_ids(t)[:WINDOW].astype(np.intp), y[:WINDOW].astype(np.intp)) for t, y in samples if t]
    step, began, total = 0, time.time(), epochs * -(-len(data) // batch)
    for epoch in range(epochs):
        order = np.argsort([len(x) + rng.uniform(0, 24) for x, _ in data])
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        sum_loss, chars = 0.0, 0
        for rows in groups:
            lengths = np.array([len(data[i][0]) for i in rows])
            ids, y = np.zeros((lengths.max(), len(rows)), np.intp), np.zeros((lengths.max(), len(rows)), np.intp)
            for c, i in enumerate(rows):
                ids[: lengths[c], c], y[: lengths[c], c] = data[i]
            drop = (rng.random((2, h)) > 0.1).astype(np.float32) / 0.9
            loss, g = gradients(p, ids, y, lengths, drop)
            scale = 1.0 / len(rows)
            norm = np.sqrt(sum(float((v * scale) ** 2 @ np.ones(v.shape[-1])) if v.ndim == 1 else float(((v * scale) ** 2).sum()) for v in g.values()))
            scale *= min(1.0, 5.0 / max(norm, 1e-9))
            step += 1
            now = rate * min(1.0, step / 50) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * min(1.0, max(step / total, (time.time() - began) / seconds)))))
            for k in p:
                v = (g[k] * scale).astype(np.float32)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.995 * m2[k] + 0.005 * v * v
                p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
            sum_loss, chars = sum_loss + loss, chars + int(lengths.sum())
            if time.time() - began > seconds:
                break
        say(f"epoch {epoch}: loss a character {sum_loss / chars:.5f}, {time.time() - began:.0f} s")
        if time.time() - began > seconds:
            break
    return Tagger(p)
