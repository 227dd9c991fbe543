import time
from pathlib import Path

import numpy as np
import pytest

from mnemospark.llm import labelled
from mnemospark.llm.labelled import Maker, surroundings
from mnemospark.llm.personal import find_in, personal_spans, replace_personal
from mnemospark.llm.tagger import K, LABELS, VOCAB, WINDOW, Tagger, char_ids, gradients, spans, train
from mnemospark.llm.personal import MODEL

from .held_out import CARRIERS, VALUES, measure

PLAIN = ["The scheduler kept 40 entries.", "Please check the cache layer.", "We compared two snapshots over night.", "Der Planer hat den Bericht geprüft."]


@pytest.fixture(scope="module")
def tagger():
    return Tagger.load(MODEL)


def test_made_up_accuracy(tagger):
    """Texts of another seed, from the code that makes those for training."""
    maker = Maker(4321)
    tests = [maker.sample(PLAIN) for _ in range(1500)]
    right = wrong = missed = 0
    for (text, y), found in zip(tests, find_in(tagger, [t for t, _ in tests])):
        want, got = {LABELS[s[2]] for s in spans(y)}, {k for _, _, k in found}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_held_out_carriers_and_layouts(tagger):
    """Sentences and values written by hand; the code that makes samples for training has none of them."""
    got = measure(lambda texts: [{k for _, _, k in found} for found in find_in(tagger, texts)])
    recall, precision = {k: v[0] for k, v in got.items()}, {k: v[1] for k, v in got.items()}
    assert min(recall[k] for k in ("email", "phone", "id_number", "street_address")) >= 0.9 and recall["person_name"] >= 0.8
    assert min(precision.values()) >= 0.85


def test_no_carrier_is_kept():
    """Nothing of the hand-written texts is in the training code."""
    code = (Path(labelled.__file__)).read_text()
    assert not [c for kind in CARRIERS.values() for c in kind if c in code] and not [v for kind in VALUES.values() for v in kind if v in code]


def test_wrong_labels_score_low(tagger):
    maker = Maker(77)
    tests = [maker.sample(PLAIN) for _ in range(200)]
    labels = tagger.tag([t for t, _ in tests])
    same = np.mean([(a == y).mean() for a, (t, y) in zip(labels, tests) if len(y)])
    other = np.mean([(a[: len(y)] == y[: len(a)]).mean() for a, (_, y) in zip(labels[1:], tests) if len(y) and len(a)])
    assert same > 0.99 > other


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in Tagger.fresh(4, 1).p.items()}
    p |= {"trans": rng.normal(0, 0.3, (K, K)), "start": rng.normal(0, 0.3, K), "end": rng.normal(0, 0.3, K)}
    ids, y, n = rng.integers(1, VOCAB, (6, 3)), rng.integers(0, K, (6, 3)), np.array([6, 4, 1])
    _, g = gradients(p, ids, y, n)
    for k in ("rf", "rb", "of", "ob", "bias", "trans", "start", "end"):
        at = tuple(s // 2 for s in p[k].shape)
        losses = []
        for d in (0.01, -0.01):
            q = p | {k: p[k].copy()}
            q[k][at] += d
            losses.append(gradients(q, ids, y, n)[0])
        assert abs((losses[0] - losses[1]) / 0.02 - g[k][at]) < 2e-3


def test_training_learns():
    maker = Maker(5)
    data = [maker.sample(PLAIN) for _ in range(300)]
    said = []
    train(data, h=8, epochs=25, batch=64, say=said.append)
    loss = [float(s.split()[5].rstrip(",")) for s in said]
    assert loss[-1] < 0.7 * loss[0]


def test_decoding_matches_plain_viterbi(tagger):
    maker = Maker(6)
    texts = [maker.sample(PLAIN)[0] for _ in range(60)]
    t = tagger.p["trans"]
    from mnemospark.llm.tagger import WINDOW, char_ids

    scores = tagger.emissions([char_ids(x)[:WINDOW] for x in texts])
    for e, got in zip(scores, tagger.decode(scores)):
        if not len(e):
            continue
        s, back = tagger.p["start"] + e[0], []
        for i in range(1, len(e)):
            x = s[:, None] + t
            back.append(x.argmax(0))
            s = x.max(0) + e[i]
        k = int((s + tagger.p["end"]).argmax())
        path = [k]
        for b in reversed(back):
            k = int(b[k])
            path.append(k)
        assert path[::-1] == got.tolist()


def test_long_texts_as_short_ones(tagger):
    """What stands anywhere in a long text is found, across the seams of the windows."""
    one = "Forward the digest to anna.berg@quillworks.example, thanks. "
    fill = "The scheduler kept 40 entries and the cache layer was checked over night. "
    for lead in range(0, 300, 37):
        text = (fill * 10)[: 150 + lead] + " " + one + fill * 40
        assert any(k == "email" and text[a:b] == "anna.berg@quillworks.example" for a, b, k in find_in(tagger, [text])[0])


def test_runtime_as_numpy(tagger, monkeypatch):
    """ONNX Runtime and numpy give the same scores and labels, texts of all lengths, empty ones too."""
    pytest.importorskip("onnxruntime")
    maker = Maker(8)
    texts = [maker.sample(PLAIN)[0] for _ in range(200)]
    texts += ["", "x", texts[0] * 40, "", "é€\U0001f600 " * 200]
    windows = [char_ids(t)[:WINDOW] for t in texts]
    plain = Tagger(tagger.p)
    monkeypatch.setattr(plain, "_runner", lambda d: None)
    assert tagger._runner("f") and tagger._runner("b")
    for a, b, w in zip(tagger.emissions(windows), plain.emissions(windows), windows):
        assert a.shape == b.shape == (len(w), K) and np.abs(a - b).max(initial=0) < 1e-4
    for a, b, t in zip(tagger.tag(texts), plain.tag(texts), texts):
        assert len(a) == len(t) and a.tolist() == b.tolist()
    assert tagger.tag([]) == [] and tagger.emissions([]) == []


def test_cost_of_tagging(tagger):
    """A character costs less than 1.7 times what numpy takes for the tanh of its gates and cells alone (2.0 to 2.9 when numpy did it all)."""
    pytest.importorskip("onnxruntime")
    maker = Maker(9)
    texts = [" ".join(PLAIN[(i + k) % 4] for k in range(4)) for i in range(2000)] + [maker.sample(PLAIN)[0] for _ in range(200)]
    chars, x = sum(map(len, texts)), np.random.default_rng(0).normal(0, 1.5, (4, 768, 20)).astype(np.float32)
    y = np.empty_like(x)

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    tagger.tag(texts[:10])
    ours, tanh = (min(t) for t in zip(*((seconds(lambda: tagger.tag(texts)), seconds(lambda: [np.tanh(x, out=y) for _ in range(100)])) for _ in range(5))))
    assert ours / chars < 1.7 * 200 * tanh / (100 * x.size)


def test_frames(spark):
    rows = [("1", "Please write to tiberia.lund@oakmarrow.test when it is done."), ("2", None), ("3", ""), (None, "Assigned to Kasimira Ostrowick for review."), ("5", "Nothing here."), ("1", "Call 505-555-0179 before noon. " + "x " * 20_000)]
    df = spark.createDataFrame(rows, "id string, body string").selectExpr("*", "1 AS text", "2 AS kind", "'z' AS start")
    found = {(r["id"], r["kind"]) for r in personal_spans(df, df.id, df.body).collect()}
    assert found == {("1", "email"), (None, "person_name"), ("1", "phone")}
    new = {(r["id"], r["text"]) for r in replace_personal(df, df.id, df.body).collect()}
    assert ("1", "Please write to [EMAIL] when it is done.") in new and ("2", None) in new and ("3", "") in new and ("5", "Nothing here.") in new
    assert personal_spans(df.limit(0), df.id, df.body).count() == 0


def test_surroundings():
    assert surroundings(["A cat sat. Mail x@y.z now."] * 70) == ["A cat sat."]
