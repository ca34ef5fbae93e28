"""Word memo of the packing tokenizer: the library's ids, and each distinct part tokenised once."""

import random

import numpy as np

from cmdlens.llm import harmonic_pack


def tokens():
    return harmonic_pack._Tokens(harmonic_pack._tokenizer_path(None))


def test_ids_are_the_librarys(monkeypatch):
    monkeypatch.setattr(harmonic_pack, "MEMO_WORDS", 20)   # memos turn over between batches
    t, r = tokens(), random.Random(5)
    signs = ["a", "The", "über", "\n", "\n\n", " ", "  ", ",", "'s", "don't", "x1", "語", "\t", "\r\n", " ", "<|endoftext|>", "\0", "---", "\na.", ".\nB", "🙂"]
    for _ in range(60):
        batch = ["".join(r.choice([" ", ""]) + r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 9))]
        batch += r.sample(["", " ", "  ", "\n", " a", "a ", "a", "\n\nThe end\nof it,\nall"], 4)
        for text, ids in zip(batch, t(batch), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_line_starts_are_tokenised_once():
    t, seen = tokens(), []
    letters = t._letters
    t._letters = lambda before, word: (seen.append((before, word)), letters(before, word))[1]
    list(t(["x " + " ".join(f"{a}.\n{b}" for a in ("ab", "cd", "ef") for b in ("Gh", "Ij"))] * 3))
    assert sorted(seen) == [("", "Gh"), ("", "Ij"), (" ", "ab"), (" ", "cd"), (" ", "ef")]
