"""Sentences and words of a text, as the language models and the reading-level features take them."""

from __future__ import annotations

import re

from trendloom.llm.lookalike import DOUBTFUL, skeleton

_DOUBTFUL = re.compile(DOUBTFUL)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+|[\r\n]+|(?<=[.!?…][\"”»])\s+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")


def sentences(text: str | None) -> list[str]:
    """The parts of a text between sentence ends and line ends that hold a word; look-alike letters are plain ones."""
    if not text:
        return []
    return [s for s in _SENTENCE.split(skeleton(text) if _DOUBTFUL.search(text) else text) if s and _WORD.search(s)]


def words(sentence: str) -> list[str]:
    """Lower-case words; numbers are ``0``, capitalised words after the first one are ``<n>`` (names), runs of them one."""
    out: list[str] = []
    for k, w in enumerate(_WORD.findall(_NUMBER.sub("0", sentence))):
        if k and w[0].isupper():
            if out[-1] != "<n>":
                out.append("<n>")
        else:
            out.append(w.lower())
    return out
