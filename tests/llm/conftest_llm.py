from __future__ import annotations

#: Texts that every operator must take: none, empty, blank, odd and repeated ones.
ODD = [None, "", " \n\t", "a", "a", "é 😀\x00 ▁", "word " * 3000, "x" * 20000, "same same text here", "same same text here"]
