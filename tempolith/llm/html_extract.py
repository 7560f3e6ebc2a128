"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes a sequence of leaf blocks, the runs of text between block-level tags, each
with features of its ancestors (tags, and words of class, id and role) and of its text.  The
field is trained by gradient ascent on the log-likelihood of labelled pages and decoded by
Viterbi, a page at a time; documents never leave their task.

Defined cases: null, empty and text-free pages give an empty text; unclosed and misplaced
tags are repaired as browsers do for the tags that matter; scripts, styles, comments and
other unrendered elements are never text; repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNRENDERED = frozenset("script style title textarea iframe noembed noframes template xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul button label".split()
)
#: Tags that an opening tag closes first.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "p": ("p",),
}
_ANCESTORS = (
    "nav header footer aside form article main section ul ol li table td a button label select p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption dl dialog menu address details fieldset"
).split()
#: Families of words in class, id and role.
_FAMILIES = {
    "comment": "comment comments commenter reply replies respond disqus discussion reactions reader readers feedback",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner adbox adslot",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc skip sitemap links",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail teaser teasers more",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup privacy paywall banner warning toast",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header head masthead topbar top logo branding brand site tagline",
    "share": "share sharing social follow tags tag meta byline author",
    "form": "form login signin register search contact input field",
    "body": "content article post entry story body text main page copy maincontent",
    "hidden": "hidden print screenreader sr offscreen",
}
_FAMILY_OF = {w: f for f, words in _FAMILIES.items() for w in words.split()}
_BITS = {name: 1 << i for i, name in enumerate([*_ANCESTORS, *(f"is-{f}" for f in _FAMILIES)])}
_TEXT_FEATURES = (
    "bias w<3 w<8 w<20 w<50 w>=50 link=0 link<.3 link<.8 link>=.8 sentence commas copyright first early late last digits upper shout "
    "after-heading many-stops pipe arrow question"
).split()
FEATURES = [*_BITS, *(f"own-{t}" for t in _ANCESTORS), *_TEXT_FEATURES]
_PLACE = {f: i for i, f in enumerate(FEATURES)}
_OWN = {t: _PLACE[f"own-{t}"] for t in _ANCESTORS}
_STOPS = re.compile(r"[.!?;:](?:\s|$)")


@dataclass
class Block:
    """A leaf block: its text, the bits of its ancestors, its own tag, and its characters inside links."""

    text: str
    mask: int
    tag: str
    linked: int


def _own_bits(name: str, attrs: str) -> int:
    bits = _BITS.get(name, 0)
    if attrs and "=" in attrs:
        for found in _NAMED.finditer(attrs):
            for word in _NAME_WORDS.findall(found[1] or found[2] or found[3] or ""):
                family = _FAMILY_OF.get(word.lower())
                if family:
                    bits |= _BITS[f"is-{family}"]
    return bits


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks of a page, in order."""
    blocks: list[Block] = []
    names, masks, opened = ["#"], [0], {}
    parts: list[str] = []
    linked = 0

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next((n for n in reversed(names) if n in _BLOCK), "#")
                blocks.append(Block(text, block_mask, at, linked))
            parts.clear()
        linked = 0

    def pop_to(name: str):
        while True:
            top = names.pop()
            masks.pop()
            opened[top] -= 1
            if top == name:
                return

    block_mask, at, size, seen = 0, 0, len(html), html.find(">")
    lower = None
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            run = html[at:start]
            if "&" in run:
                run = unescape(run)
            if not parts or not block_mask:
                block_mask = masks[-1]
            parts.append(run)
            if opened.get("a"):
                linked += len(run)
        if start >= size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        following = html[start + 1 : start + 2]
        if following in ("!", "?"):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        if seen < start:
            seen = html.find(">", start)
        found = _TAG.match(html, start) if seen >= 0 else None
        if not found:
            parts.append("<")
            at = start + 1
            if seen < 0 and not following.isalpha():
                continue
            if seen < 0:  # an unfinished tag ends the page
                parts.pop()
                break
            continue
        at = found.end()
        closing, name, attrs = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            close_block()
        if closing:
            if opened.get(name):
                pop_to(name)
            continue
        if name in _VOID:
            continue
        if name in _UNRENDERED:
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{name}", at) if len(lower) == size else html.find(f"</{name}", at)
            if end < 0:
                at = size
            else:
                end = html.find(">", end)
                at = size if end < 0 else end + 1
            continue
        if name in _BLOCK:
            for other in _CLOSES.get(name, ()):
                if opened.get(other) and (other != "li" or names[-1] == "li" or not _nested_list(names)):
                    pop_to(other)
            if name != "p" and name not in ("button", "label", "option", "select") and opened.get("p"):
                pop_to("p")
        names.append(name)
        masks.append(masks[-1] | _own_bits(name, attrs))
        opened[name] = opened.get(name, 0) + 1
    close_block()
    return blocks


def _nested_list(names: list[str]) -> bool:
    """Whether a list was opened inside the innermost open item."""
    for name in reversed(names):
        if name == "li":
            return False
        if name in ("ul", "ol", "menu", "table"):
            return True
    return True


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features that hold, for each block."""
    out, p, n = [], _PLACE, len(blocks)
    names = list(_BITS)
    by_mask: dict[int, list[int]] = {}
    heading = False
    for i, b in enumerate(blocks):
        if b.mask not in by_mask:
            by_mask[b.mask] = [p[name] for name in names if b.mask & _BITS[name]]
        f = [p["bias"], *by_mask[b.mask]]
        if b.tag in _OWN:
            f.append(_OWN[b.tag])
        text = b.text
        count = text.count(" ") + 1
        f.append(p["w<3" if count < 3 else "w<8" if count < 8 else "w<20" if count < 20 else "w<50" if count < 50 else "w>=50"])
        share = b.linked / (len(text) + 1)
        f.append(p["link=0" if not share else "link<.3" if share < 0.3 else "link<.8" if share < 0.8 else "link>=.8"])
        if text[-1] in ".!?:\"'”»…":
            f.append(p["sentence"])
        if "," in text:
            f.append(p["commas"])
        if "©" in text or "®" in text:
            f.append(p["copyright"])
        if i == 0:
            f.append(p["first"])
        if i * 5 < n:
            f.append(p["early"])
        if i * 5 >= 4 * n:
            f.append(p["late"])
        if i == n - 1:
            f.append(p["last"])
        if text[0].isdigit():
            f.append(p["digits"])
        if text[0].isupper():
            f.append(p["upper"])
        if len(text) > 3 and text.isupper():
            f.append(p["shout"])
        if heading:
            f.append(p["after-heading"])
        if count >= 12 and len(_STOPS.findall(text)) >= 2:
            f.append(p["many-stops"])
        if "|" in text:
            f.append(p["pipe"])
        if "»" in text or "→" in text or "›" in text:
            f.append(p["arrow"])
        if text[-1] == "?":
            f.append(p["question"])
        heading = b.tag[0] == "h" and b.tag[1:].isdigit()
        out.append(f)
    return out


@dataclass
class ChainField:
    """Weights of a linear-chain field with the labels 0 (boilerplate) and 1 (main text)."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2

    def __post_init__(self):
        self._gain = (self.emit[:, 1] - self.emit[:, 0]).tolist()
        self._move = self.move.tolist()

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not features:
            return []
        (m00, m01), (m10, m11) = self._move
        gain = self._gain
        back, s0, s1 = [], 0.0, 0.0
        for i, f in enumerate(features):
            g = sum([gain[k] for k in f])
            if i == 0:
                s1 = g
                continue
            from0, from1 = s0 + m01, s1 + m11
            stay0, stay1 = s0 + m00, s1 + m10
            back.append((int(stay1 > stay0), int(from1 > from0)))
            s0, s1 = max(stay0, stay1), max(from0, from1) + g
        labels = [int(s1 > s0)]
        for b in reversed(back):
            labels.append(b[labels[-1]])
        return labels[::-1]


def train_field(pages: Iterable[tuple[list[list[int]], list[int]]], *, rounds: int = 150, rate: float = 0.1, penalty: float = 2e-4) -> ChainField:
    """Gradient ascent (Adam) on the penalised mean log-likelihood of labelled feature sequences."""
    pages = [p for p in pages if p[0]]
    steps = max(len(f) for f, _ in pages)
    x = np.zeros((len(pages), steps, len(FEATURES)))
    gold, live = np.zeros((len(pages), steps), int), np.zeros((len(pages), steps), bool)
    for i, (features, labels) in enumerate(pages):
        for t, f in enumerate(features):
            x[i, t, f] = 1.0
        gold[i, : len(labels)] = labels
        live[i, : len(labels)] = True
    total = live.sum()
    hot = np.stack([gold == 0, gold == 1], -1) * live[..., None]
    pair = np.einsum("pti,ptj->ij", hot[:, :-1].astype(float), hot[:, 1:].astype(float))
    flat = x[live]
    theta = np.zeros(2 * len(FEATURES) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emit, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        score = np.zeros((len(pages), steps, 2))
        score[live] = flat @ emit
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0]
        for t in range(1, steps):
            new = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + score[:, t]
            fwd[:, t] = np.where(live[:, t, None], new, fwd[:, t - 1])
        norm = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        expected = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            on = live[:, t + 1]
            ahead = score[:, t + 1] + bwd[:, t + 1]
            both = fwd[:, t, :, None] + move + ahead[:, None, :] - norm[:, None, None]
            expected += np.exp(both[on]).sum(0)
            new = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            bwd[:, t] = np.where(on[:, None], new, 0.0)
        marginal = np.exp(fwd + bwd - norm[:, None, None]) * live[..., None]
        slope = np.concatenate([(flat.T @ (hot - marginal)[live]).ravel(), (pair - expected).ravel()]) / total - penalty * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return ChainField(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def fit(labelled: Iterable[tuple[str, set[str]]], **options) -> ChainField:
    """A field from pages with the set of their main blocks' texts."""
    rows = []
    for html, main in labelled:
        blocks = leaf_blocks(html)
        rows.append((block_features(blocks), [int(b.text in main) for b in blocks]))
    return train_field(rows, **options)


def main_text(html: str | None, field: ChainField) -> str:
    """Main blocks in page order, joined by an empty line."""
    blocks = leaf_blocks(html) if html else []
    return "\n\n".join(b.text for b, keep in zip(blocks, field.decode(block_features(blocks))) if keep)


def extract(pages: DataFrame, field: ChainField, *, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """id_cols, text and n_chars (code points) of every page, map-side.  id_cols must not be named text or n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    slim = pages.select(*[F.col(f"`{c}`") for c in id_cols], F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*id_cols, "text", "n_chars"]
            )

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{ids}, text string, n_chars long")
