"""Word hashes: in spans of a bounded size, the same as over all bytes at once."""

import numpy as np
import pyarrow as pa

from wirelens.llm import arrays


def test_words_are_hashed_in_spans(monkeypatch):
    texts = ["", None, "a bc  é\t漢字 " * 40, "x" * 300, " \n", "one " + "y" * 70 + " two", "z", *(f"w{i} " * (i % 5) for i in range(200))]
    data, offsets = arrays.text_bytes(pa.array(texts))
    starts, ends, _ = arrays.word_spans(data, offsets)
    wanted = arrays.spans_hash(arrays.prefix_sums(data.astype(np.uint64) + np.uint64(1)), starts, ends)
    sizes, sums = [], arrays.prefix_sums
    monkeypatch.setattr(arrays, "prefix_sums", lambda values: sizes.append(len(values)) or sums(values))
    for span in (1, 64, 1 << 15):
        monkeypatch.setattr(arrays, "SPAN", span, raising=False)
        sizes.clear()
        assert np.array_equal(arrays.word_hashes(data, starts, ends), wanted)
        assert max(sizes) <= max(span, 300)
    assert len(arrays.word_hashes(data, starts[:0], ends[:0])) == 0
