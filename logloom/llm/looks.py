"""What a text looks like: one form for all texts that look the same.

Strings and code points that look alike are joined by union-find, so the relation is
transitive: width forms, ligatures, letters of other scripts and blocks, kinds of blanks,
invisible characters (alike the empty string). Each class has one representative: the
string that is spelt out where there is one, else the member most frequent in the corpus,
so most text stays as it is (accents by the combining one, so that they sort; of
equals the one that Unicode does not decompose, then the first). An automaton over all other members rewrites texts greedily.
Superscripts, subscripts, accents, case, digits and punctuation stay apart.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

#: Letters and signs that look like a letter or sign of another script or block.
_LIKE = (
    "AΑАᎪ", "BΒВ", "CСϹ", "EΕЕ", "GԌ", "HΗН", "IΙІӀ", "JЈ", "KΚК", "MΜМ", "NΝ", "OΟОՕ", "PΡР", "QԚ",
    "SЅ", "TΤТ", "WԜ", "XΧХ", "YΥҮУ", "ZΖ", "dԀԁ", "hҺһհ", "aαаɑ", "cсϲ", "eе", "gɡ", "iιіɩ",
    "jјϳ", "lӏ", "nո", "oοоօ", "pρр", "qԛ", "sѕ", "uυսᴜ", "vνѵᴠ", "wԝѡᴡ", "xх", "yуγү", "zᴢ", "VѴ", "FϜ", "ʼ’", "ʹ′",
    "-−‐‑‒–﹘⁃˗", "/∕⁄", "Σ∑", "Π∏", "Δ∆", ":∶", "~∼", "|∣", "·∙⋅‧・", "°˚", ",‚",
    "*∗", "ヘへ", "ニ二", "カ力", "ロ口", "エ工", "ト卜", "タ夕", "ハ八",
)
#: Characters that show nothing, and those that end a line.
_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
_ENDS = "\r\x0b\x0c\x85  "
#: Compatibility forms that differ by width, font, place in a word or block alone.
_FORMS = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>", "<vertical>")
#: Blocks whose other compatibility forms look like what they stand for.
_BLOCKS = ((0xB5, 0xB5), (0x132, 0x133), (0x149, 0x149), (0x17F, 0x17F), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0x3131, 0x318E), (0xFB00, 0xFB4F))


def look_alikes() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike: of the fixed list and, by rule, of Unicode's data."""
    for group in _LIKE:
        for other in group[1:]:
            yield group[0], other
    yield "\n", "\r\n"
    for end in _ENDS:
        yield "\n", end
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" or char in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
            yield "", char
        elif kind == "Zs" or char == "\t":
            yield " ", char
        elif found := unicodedata.decomposition(char):
            how, _, points = found.partition(" ")
            if how in _FORMS or (how[0] == "<" and any(a <= code <= b for a, b in _BLOCKS)):
                yield unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in points.split())), char


class Classes:
    """Union-find over strings."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        self.parent: dict[str, str] = {}
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[b] = a

    def root(self, node: str) -> str:
        self.parent.setdefault(node, node)
        top = node
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[node] != top:
            self.parent[node], node = top, self.parent[node]
        return top

    def members(self) -> list[list[str]]:
        out = defaultdict(list)
        for node in self.parent:
            out[self.root(node)].append(node)
        return list(out.values())


def _best(members: list[str], counts: Mapping[int, int]) -> str:
    spelt = [m for m in members if len(m) > 1 and m != "\r\n"]
    if "" in members or spelt:
        return "" if "" in members else min(spelt, key=lambda m: (-min(counts.get(ord(c), 0) for c in m), len(m), m))
    return max((m for m in members if len(m) == 1), key=lambda m: (unicodedata.combining(m) > 0, counts.get(ord(m), 0), not unicodedata.decomposition(m), -ord(m)))


@lru_cache(maxsize=1)
def classes() -> list[list[str]]:
    """Classes of look-alike strings, of two members or more."""
    return Classes(look_alikes()).members()


def rewrites(counts: Mapping[int, int] | None = None) -> dict[str, str]:
    """What each member of a class becomes, where that is another string.

    ``counts`` are code points of the corpus. In a class of line ends or blanks the plain
    one stands for all: what a blank looks like is no matter of counts.
    """
    best: dict[str, str] = {}
    for members in classes():
        plain = next((m for m in ("\n", " ") if m in members), None)
        chosen = plain or _best(members, counts or {})
        best.update(dict.fromkeys(members, chosen))

    def final(text: str) -> str:
        # spelt-out strings are rewritten character by character in their turn
        return "".join(c if best.get(c, c) == c else final(best[c]) for c in text)

    return {m: to for m, chosen in best.items() if m and len(m) == 1 or m == "\r\n" if (to := final(chosen)) != m}


def countable() -> list[int]:
    """Code points whose counts decide on a representative."""
    return sorted({ord(m) for members in classes() if "" not in members for m in members if len(m) == 1})


class Rewriter:
    """Greedy rewriting by an automaton over all strings that change.

    The start state knows the characters that begin a pattern; a text that holds none of
    them is left at once. Patterns of one character are loops on the start state, run by
    the string type itself; those that share a beginning with a longer one go through a
    trie, the longest match first. What is written is never rewritten again, since no
    representative holds a pattern.
    """

    _FEW = 8

    def __init__(self, changes: Mapping[str, str]) -> None:
        self.changes = dict(changes)
        self.begins = frozenset(old[0] for old in changes)
        self.deep = frozenset(old[0] for old in changes if len(old) > 1)
        self.single = {ord(old): new for old, new in changes.items() if old not in self.deep and len(old) == 1}
        self.trie: dict = {}
        for old, new in changes.items():
            if old[0] in self.deep:
                node = self.trie
                for char in old:
                    node = node.setdefault(char, {})
                node[""] = new

    def _walk(self, text: str, begins: set[str]) -> str:
        out, at = [], 0
        place = min((text.find(c) for c in begins if c in text), default=-1)
        while place >= 0:
            node, i, end, new = self.trie, place, -1, ""
            while i < len(text) and text[i] in node:
                node = node[text[i]]
                i += 1
                if "" in node:
                    end, new = i, node[""]
            if end > 0:
                out += (text[at:place], new)
                at = end
            place = min((p for c in begins if (p := text.find(c, max(at, place + 1))) >= 0), default=-1)
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        """The form that all texts have in common that look like ``text``."""
        plain = text.isascii()
        if not plain:
            text = unicodedata.normalize("NFD", text)
        held = self.begins.intersection(text)
        if deep := held & self.deep:
            text = self._walk(text, deep)
        held -= self.deep
        if len(held) > self._FEW:
            text = text.translate(self.single)
        else:
            for char in held:
                text = text.replace(char, self.changes[char])
        return text if plain else unicodedata.normalize("NFD", text)


@lru_cache(maxsize=1)
def plain_rewriter() -> Rewriter:
    """A rewriter without counts: of letters that look alike the first code point stands."""
    return Rewriter(rewrites())


def looks(text: str) -> str:
    """The common form of a text by ``plain_rewriter``."""
    return plain_rewriter()(text)
