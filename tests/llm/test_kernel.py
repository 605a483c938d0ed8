import numpy as np
import pyarrow as pa

from tessera.llm import kernel


def test_text_buffers_of_slices_and_nulls():
    data, off = kernel.text_buffers(pa.array(["ab", None, "", "é"]).slice(1))
    assert data.tobytes() == "é".encode() and off.tolist() == [0, 0, 0, 2]
    assert [x.tolist() for x in kernel.text_buffers(pa.array([], pa.string()))] == [[], [0]]


def test_blocks_hold_whole_documents():
    off = np.array([0, 3, 3, 10, 11, 30])
    assert list(kernel.blocks(off, 10)) == [(0, 3), (3, 4), (4, 5)]


def test_spans_never_cross_documents():
    data = np.frombuffer(b"ab cdef  g", np.uint8)
    s, e, at = kernel.spans(data, np.array([0, 5, 5, 10]), kernel.LETTER)
    assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"ef", b"g"] and at.tolist() == [0, 2, 2, 4]


def test_equal_spans_hash_alike():
    data = np.frombuffer(b"one two one", np.uint8)
    h = kernel.span_hashes(kernel.prefix_sums(data), np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1] and kernel.hash_words([b"two", b"one"]).tolist() == [h[1], h[0]]
