"""One direction of an LSTM as a model for ONNX Runtime, written out by hand so that only the runtime is needed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

# Numbers of the protocol: element types, attribute types.
_FLOAT, _INT32 = 1, 6
_IS_INT, _IS_GRAPH = 2, 5


def _int(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _int(number << 3) + _int(value)
    value = value.encode() if isinstance(value, str) else value
    return _int(number << 3 | 2) + _int(len(value)) + value


def _tensor(name: str, x: np.ndarray) -> bytes:
    return _field(5, b"".join(_field(1, n) for n in x.shape) + _field(2, _FLOAT) + _field(8, name) + _field(9, x.tobytes()))


def _value(role: int, name: str, kind: int, *shape: int | str) -> bytes:
    dims = b"".join(_field(1, _field(2 if isinstance(n, str) else 1, n)) for n in shape)
    return _field(role, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims))))


def _whole(name: str, n: int) -> bytes:
    return _field(5, _field(1, name) + _field(3, n) + _field(20, _IS_INT))


def _node(op: str, inputs: str, outputs: str, *attributes: bytes) -> bytes:
    return _field(1, b"".join(_field(1, x) for x in inputs.split()) + b"".join(_field(2, x) for x in outputs.split()) + _field(4, op) + b"".join(attributes))


def model(table: np.ndarray, rec: np.ndarray, proj: np.ndarray) -> bytes:
    """ids (T, B) and first states (B, h) to out (T, B, K); gates stand in the order input, forget, output, candidate."""
    h, k = proj.shape
    given, made = 11, 12
    step = [
        _node("Gather", "table id", "x"),
        _node("Gemm", "hidden rec x", "gates"),
        _node("Split", "gates", "gi gf go gc", _whole("axis", 1)),
        *(_node("Sigmoid", "g" + x, x) for x in "ifo"),
        _node("Tanh", "gc", "candidate"),
        _node("Mul", "f cell", "kept"),
        _node("Mul", "i candidate", "added"),
        _node("Add", "kept added", "next_cell"),
        _node("Tanh", "next_cell", "shown"),
        _node("Mul", "o shown", "next_hidden"),
        _node("MatMul", "next_hidden proj", "each"),
        _field(2, "step"),
        *(_value(given, n, _FLOAT, "B", h) for n in ("hidden", "cell")),
        _value(given, "id", _INT32, "B"),
        *(_value(made, n, _FLOAT, "B", h) for n in ("next_hidden", "next_cell")),
        _value(made, "each", _FLOAT, "B", k),
    ]
    graph = [
        _node("Scan", "hidden0 cell0 ids", "last_hidden last_cell out", _field(5, _field(1, "body") + _field(6, b"".join(step)) + _field(20, _IS_GRAPH)), _whole("num_scan_inputs", 1)),
        _field(2, "direction"),
        *(_tensor(n, np.ascontiguousarray(x, np.float32)) for n, x in (("table", table), ("rec", rec), ("proj", proj))),
        *(_value(given, n, _FLOAT, "B", h) for n in ("hidden0", "cell0")),
        _value(given, "ids", _INT32, "T", "B"),
        _value(made, "out", _FLOAT, "T", "B", k),
    ]
    return _field(1, 8) + _field(7, b"".join(graph)) + _field(8, _field(1, "") + _field(2, 13))


def runner(table: np.ndarray, rec: np.ndarray, proj: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
    """(T, B) ids to (T, B, K) on one thread; None where the runtime isn't installed."""
    if onnxruntime is None:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(model(table, rec, proj), options, providers=["CPUExecutionProvider"])

    def run(ids: np.ndarray) -> np.ndarray:
        zeros = np.zeros((ids.shape[1], len(rec)), np.float32)
        return session.run(None, {"hidden0": zeros, "cell0": zeros, "ids": ids})[0]

    return run
