"""What a worker remembers of BPE loses the pieces that no longer occur, not the frequent ones."""

import numpy as np

from helixspark.llm import bpe


def test_frequent_pieces_stay(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 800 * bpe.ENTRY)
    c = bpe.Codec(*bpe.vocabulary(None))
    met, real = [], c.fixpoint
    monkeypatch.setattr(c, "fixpoint", lambda found: met.extend(found) or real(found))
    for k in range(30):
        got = c.encode([" common words" + "".join(f" r{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))])
        assert c.decode([np.frombuffer(b"".join(got[0]), "<u4")])[0].startswith(b" common words ra" if not k else b" common words r")
    assert met.count(b" common") == met.count(b" words") == 1
    assert len(c.memory) + len(c.older) <= 1000
