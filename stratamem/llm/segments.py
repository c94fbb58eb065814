"""Encoding by the tokenizers library through a memo of segments between which no token can run.

A text is cut where the pre-tokenizers of the supported vocabularies always cut: before a
space or newline that follows another character, and after a run of Latin letters that an
ASCII non-letter follows. So the ids of a text are those of its segments in order, and each
distinct segment goes through the library once per worker and memo.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Entries of a memo; beyond that it starts anew.
MEMO = 700_000
#: Longer segments are not kept.
LONGEST = 64

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?![A-Za-z]|[^\\x00-\\x7f])"
#: Keeps white space at the front of the segment it belongs to.
WITH_SPACE = re.compile(f"[ \\n]*{_LETTERS}|[ \\n]*[^ \\n]+|[ \\n]+")
#: For vocabularies that drop white space.
NO_SPACE = re.compile(f"{_LETTERS}|[^ \\n]+")
#: A character beyond Latin-1; elsewhere Python lower-cases as the library does.
WIDE = re.compile("[^\x00-\xff]")
#: White space other than the two characters at which texts are cut.
OTHER_SPACE = re.compile(r"[^\S \n]")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: A segment that is one pre-token: a run of Latin letters, after one space or nothing.
ONE_PRETOKEN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def lowered(text: str) -> str:
    """The text in lower case where that can't change its ids in a vocabulary that lower-cases: fewer distinct segments."""
    return text if "<|" in text or WIDE.search(text) else text.lower()


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class Memo(dict):
    """Segment -> ``value(ids)``, filled as segments are asked for.

    A segment that is one pre-token goes straight to the library's model, in the letters
    that the vocabulary uses for bytes; any other goes through the whole library. Long
    segments are not kept, and a full memo starts anew.
    """

    def __init__(self, tokenizer, value, lower: bool):
        super().__init__()
        self.tokenizer, self.value, self.lower = tokenizer, value, lower
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, segment: str):
        if ONE_PRETOKEN.fullmatch(segment):
            word = segment.lower() if self.lower else segment
            if word.isascii():
                letters = f"{_BYTE_LETTERS[32]}{word[1:]}" if word[0] == " " else word
            else:
                letters = "".join([_BYTE_LETTERS[b] for b in word.encode()])
            found = self.value([t.id for t in self.tokenize(letters)])
        else:
            found = self.value(self.tokenizer.encode(segment, add_special_tokens=False).ids)
        if len(segment) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[segment] = found
        return found
