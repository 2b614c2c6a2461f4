"""The windows of a block come back with their answers, so its text is not read and cut into windows once more."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import zstandard

from matchloom.llm import substring as S


def test_candidates_come_from_the_answers_alone():
    shared = " ".join(f"s{i}" for i in range(70))
    texts = [f"{' '.join(f'{x}{i}' for i in range(20))} {shared} {x}".encode() for x in "ab"]
    row = SimpleNamespace(doc_ids=[1, 2], sizes=[len(t) for t in texts], raw=sum(map(len, texts)), texts=zstandard.ZstdCompressor().compress(b"".join(texts)))
    g, width = S.Grams(row, S.N), S.PASSAGE_WORDS - S.N + 1
    key, r_, c, l, r, fn = S._windows(g, width, S.HASHES, (np.zeros(1 << 13, np.uint8), 16))
    columns = [S._by_plane(x) for x in (g.ids[r_], *(x.astype(np.int32) for x in (r_ + (fn << S.FUNCTION_BITS), c, c - l, r - c)), S._contents(g, r_, c, l, r))]
    asked = pd.DataFrame([(0, 3, S._planes(key), *columns)], columns=["frag", "block", "keys", "docs", "rows", "c", "before", "after", "contents"])
    found = S._candidates(S._answer(asked), S._least(width, 80, 100), S.HASHES, S.ENOUGH)
    assert found and all((x[0], x[3]) == (1, 3 << S.ROW_BITS) for x in found)
    assert min(x[1] for x in found) <= 22 and max(x[2] for x in found) >= 84 and all(x[1] == x[4] and x[2] == x[5] for x in found)
