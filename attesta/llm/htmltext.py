"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, runs of text that no block-level tag interrupts. Features of a block are
the tags and class or id words among its ancestors and the shape of its text; neighbours are tied by
transition weights. The field is trained on labelled pages of many layouts, made by ``labelled_page`` from a seed,
and decoded by Viterbi; what comes out as content is the text.

Results: a null or empty html, or a page without content, has an empty text. Scripts, styles, comments and
other raw elements never are blocks. Whole pages are read. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their role in the layout.
RAW = "script style noscript template textarea iframe svg math title select object".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table body html".split())
SECTIONS = frozenset("article aside footer form header main nav section dialog".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, class and id words), outermost first
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in their order."""
    found: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0
    base: tuple = ()

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, base, linked))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked, base
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            if not parts or not base:
                base = tuple(p for p in path if p[0] not in INLINE or p[1])
            parts.append(text)
            if links:
                linked += len(text)

    def leave(index: int) -> None:
        nonlocal links
        links -= sum(tag == "a" for tag, _ in path[index:])
        if any(tag not in INLINE for tag, _ in path[index:]):
            close()
        del path[index:]

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() != "svg":
                parts.append(" ")
            continue
        if m[2]:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag or (tag in HEADINGS and path[k][0] in HEADINGS):
                    leave(k)
                    break
            else:
                if tag not in INLINE:
                    close()
            continue
        if tag not in INLINE:
            close()
        if tag in VOID:
            parts.append(" ")
            continue
        closing = {"p"} if tag in ENDS_PARAGRAPH else CLOSED_BY.get(tag)
        if closing:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] in closing:
                    leave(k)
                    break
                if path[k][0] in SCOPE or (tag in ENDS_PARAGRAPH and path[k][0] not in INLINE):
                    break
        words = tuple(WORD.findall(" ".join("".join(x) for x in NAMED.findall(m[4])).lower())) if "=" in m[4] else ()
        path.append((tag, words))
        links += tag == "a"
    say(page[at:])
    close()
    return found


def _since(tags: list[str], marks: tuple[str, ...]) -> list[str]:
    """The tags below the innermost of ``marks``; without one, none."""
    inner = max((k for k, t in enumerate(tags) if t in marks), default=len(tags))
    return tags[inner + 1 :]


def features(page: list[Block]) -> list[set[str]]:
    """Names of the features of each block."""
    out, known = [], {}
    for k, block in enumerate(page):
        own = known.get(block.path)
        if own is None:
            own = {f"tag {t}" for t, _ in block.path} | {f"word {w}" for _, ws in block.path for w in ws}
            sections = [t for t, ws in block.path if t in SECTIONS]
            own |= {f"in {a} {b}" for a, b in zip(["body", *sections], sections)} | {f"nearest {sections[-1] if sections else 'none'}"}
            own.add(f"leaf {block.path[-1][0] if block.path else 'none'}")
            named = [ws for _, ws in block.path if ws]
            own |= {f"innermost {w}" for w in (named[-1] if named else ())}
            own |= {f"below {t}" for t in _since([t for t, _ in block.path], ("article", "main"))}
            known[block.path] = own
        text = block.text
        share = block.linked / len(text)
        shape = {
            f"length {min(len(text).bit_length(), 10)}",
            f"links {min(int(4 * share), 3)}",
            f"stops {min(text.count('. ') + text.count(', '), 3)}",
            f"ends {text[-1] in '.!?…:;”\"'}",
        }
        if "©" in text[:40] or "copyright" in text[:60].lower():
            shape.add("copyright")
        if k == 0:
            shape.add("first")
        if k == len(page) - 1:
            shape.add("last")
        out.append(own | shape)
    return out


@dataclass
class Field:
    """Weights of a two-label chain: 0 for the page's frame, 1 for content."""

    names: dict[str, int]
    weights: np.ndarray  # features x 2
    steps: np.ndarray  # from label x to label

    @classmethod
    def fit(cls, pages: list[tuple[list[set[str]], list[int]]], rounds: int = 200, rate: float = 0.4, decay: float = 2e-4) -> Field:
        """Maximum likelihood by gradient steps over all pages at once, padded to one length."""
        seen = sorted({n for rows, _ in pages for row in rows for n in row})
        names = {n: i for i, n in enumerate(seen)}
        longest = max(len(r) for r, _ in pages)
        widest = max(len(row) for rows, _ in pages for row in rows)
        index = np.full((len(pages), longest, widest), len(names))
        labels, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
        for p, (rows, given) in enumerate(pages):
            labels[p, : len(given)], real[p, : len(given)] = given, True
            for t, row in enumerate(rows):
                index[p, t, : len(row)] = [names[n] for n in sorted(row)]
        weights, steps = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
        sums = [np.full(w.shape, 1e-8) for w in (weights, steps)]
        truth = np.eye(2)[labels] * real[..., None]
        pair_real = (real[:, 1:] & real[:, :-1])[..., None, None]
        true_steps = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * pair_real).sum(axis=(0, 1))
        for _ in range(rounds):
            score = weights[index].sum(axis=2) * real[..., None]
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            forward[:, 0] = score[:, 0]
            for t in range(1, longest):
                go = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + score[:, t]
                forward[:, t] = np.where(real[:, t, None], go, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                back = np.logaddexp.reduce(steps + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(real[:, t + 1, None], back, 0)
            whole = np.logaddexp.reduce(forward[:, -1], axis=1)
            belief = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
            pairs = forward[:, :-1, :, None] + steps + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
            slope_steps = (true_steps - (np.exp(np.where(pair_real, pairs, -np.inf))).sum(axis=(0, 1))) / len(pages) - decay * steps
            off = truth - belief
            slope = np.stack([np.bincount(index.ravel(), np.repeat(off[..., y].ravel(), widest), len(names) + 1) for y in (0, 1)], axis=1) / len(pages)
            slope[-1] = 0
            slope -= decay * weights
            for w, g, s in ((weights, slope, sums[0]), (steps, slope_steps, sums[1])):
                s += g * g
                w += rate * g / np.sqrt(s)
        return cls(names, weights[:-1], steps)

    def decode(self, rows: list[set[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not rows:
            return []
        names, weights = self.names, self.weights
        index = [[names[n] for n in row if n in names] for row in rows]
        counts = [len(i) for i in index]
        flat = weights[[i for own in index for i in own]]
        own = np.zeros((len(rows), 2))
        np.add.at(own, np.repeat(np.arange(len(rows)), counts), flat)
        (s00, s01), (s10, s11) = self.steps.tolist()
        (a, b), *rest = own.tolist()
        back = []
        for x, y in rest:
            from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
            a, b = (a + s00 if from0 else b + s10) + x, (a + s01 if from1 else b + s11) + y
            back.append((0 if from0 else 1, 0 if from1 else 1))
        label = 0 if a >= b else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


#: Words that layouts give to the parts of a page.
PARTS = {
    "menu": "nav navbar menu navigation topnav mainnav breadcrumb breadcrumbs toolbar tabs pager pagination skip".split(),
    "header": "header masthead top banner logo branding site head".split(),
    "footer": "footer foot bottom colophon copyright legal imprint".split(),
    "sidebar": "sidebar side aside rail widget widgets related recommended popular trending more tags archive".split(),
    "ad": "ad ads advert advertisement adbox promo sponsor sponsored banner commercial teaser offer partner".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay message subscribe newsletter signup paywall".split(),
    "form": "form search login register contact newsletter subscribe field".split(),
    "comments": "comments comment commentlist discussion replies reply responses disqus respond reader".split(),
    "share": "share social sharing follow buttons tools meta byline toc".split(),
}
CONTENT = "content main article post entry story body text page hentry prose single blog news".split()


def labelled_page(rng: random.Random) -> tuple[str, dict[str, int]]:
    """A page of a random layout, and the label of each of its texts."""
    labels: dict[str, int] = {}
    syllables = "ba con de fi gra lo mu ne por qui ra sen ti vu xe zo äl éri öst ñan".split()

    def words(n: int) -> list[str]:
        return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]

    def text(label: int, low: int, high: int, stop: bool = True) -> str:
        while True:
            w = words(rng.randint(low, high))
            if stop:
                for i in range(rng.randint(5, 9), len(w) - 1, 9):
                    w[i] += rng.choice([",", "."])
            s = " ".join(w).capitalize() + ("." if stop else "")
            if labels.get(s, label) == label:
                labels[s] = label
                return s

    def named(part: str | None, chance: float = 0.8) -> str:
        if part is None or rng.random() > chance:
            return ""
        own = rng.choice(PARTS[part] if part in PARTS else CONTENT)
        other = rng.choice(["", "", "-box", "-wrap", " wide", "-1", " block", "_area"])
        return f' {rng.choice(["class", "class", "id"])}="{own}{other}"'

    def link(label: int, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text(label, low, high, False)}</a>'

    def links(n: int) -> str:
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{link(0)}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<div>{link(0)}</div>" for _ in range(n))

    def frame(part: str) -> str:
        n = rng.randint(2, 7)
        if part == "menu":
            tag = rng.choice(["nav", "nav", "div", "header"])
            return f"<{tag}{named(part, 1 if tag == 'div' else 0.4)}>{links(n)}</{tag}>"
        if part == "header":
            tag = rng.choice(["header", "header", "div"])
            inner = rng.choice([text(0, 1, 4, False), f"<h1>{text(0, 1, 4, False)}</h1>", f"<p>{text(0, 3, 12)}</p>{links(3)}"])
            return f"<{tag}{named(part, 1 if tag == 'div' else 0.4)}>{inner}</{tag}>"
        if part == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            inner = rng.choice([f"&copy; {text(0, 2, 12)}", f"<p>{text(0, 4, 20)}</p>", links(n) + f"<p>© {text(0, 2, 8)}</p>"])
            return f"<{tag}{named(part, 1 if tag == 'div' else 0.4)}>{inner}</{tag}>"
        if part == "sidebar":
            tag = rng.choice(["aside", "aside", "div", "section"])
            inner = f"<h3>{text(0, 1, 4, False)}</h3>" + rng.choice([links(n), f"<p>{text(0, 5, 30)}</p>", f"<p>{text(0, 5, 20)}</p>" * 1 + links(2)])
            return f"<{tag}{named(part, 1 if tag != 'aside' else 0.4)}>{inner}</{tag}>"
        if part == "form":
            fields = "".join(f"<label>{text(0, 1, 3, False)}</label><input type=text>" for _ in range(rng.randint(1, 3)))
            lead = rng.choice(["", f"<p>{text(0, 4, 20)}</p>"])
            return f"<form{named(part, 0.4)} action=/s>{lead}{fields}<button>{text(0, 1, 2, False)}</button></form>"
        if part == "comments":
            tag, item = rng.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article"), ("section", "p")])
            items = "".join(
                f"<{item}{named(part, 0.7)}>{rng.choice([f'<b>{text(0, 1, 2, False)}</b> ', f'<cite>{text(0, 1, 2, False)}</cite>', ''])}"
                f"{f'<p>{text(0, 4, 40)}</p>' if item != 'p' else text(0, 4, 40)}</{item}>"
                for _ in range(rng.randint(1, 4))
            )
            return f"<{tag}{named(part, 1)}><h3>{text(0, 1, 3, False)}</h3>{items}</{tag}>"
        tag = rng.choice(["div", "div", "div", "section", "p", "aside"])
        inner = rng.choice([text(0, 3, 25), link(0, 2, 8), text(0, 2, 8, False)])
        if tag != "p":
            inner = rng.choice([inner, f"<p>{text(0, 4, 40)}</p>", f"<p>{text(0, 4, 30)}</p><button>{text(0, 1, 2, False)}</button>"])
        return f"<{tag}{named(part, 1)}>{inner}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.7:
            s = text(1, 1 if rng.random() < 0.25 else 6, 90)
            if rng.random() < 0.25:
                cut = s.split(" ")
                k = rng.randrange(len(cut))
                cut[k] = f'<{(t := rng.choice(["a", "b", "i", "em", "strong", "span"]))}{" href=/x" if t == "a" else ""}>{cut[k]}</{t}>'
                s = " ".join(cut)
            return rng.choice([f"<p>{s}</p>", f"<p>{s}</p>", f"<p><b>{s}<br>", f"<p>{s}"])
        if kind < 0.8:
            return f"<{(t := rng.choice(['h2', 'h3', 'h4']))}>{text(1, 1, 9, False)}</{t}>"
        if kind < 0.87:
            return (t := rng.choice(["ul", "ol"])) and f"<{t}>" + "".join(f"<li>{text(1, 2, 20, rng.random() < 0.5)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if kind < 0.92:
            return f"<blockquote><p>{text(1, 5, 40)}</p></blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{text(1, 1, 4, False)}</td><td>{text(1, 1, 6, False)}</td></tr>" for _ in range(2)) + "</table>"
        return rng.choice([f"<pre>{text(1, 3, 12, False)}</pre>", f"<figure><img src=x><figcaption>{text(1, 3, 12)}</figcaption></figure>", f"<div>{text(1, 5, 50)}</div>"])

    def bare() -> str:
        """Text that stands in the article itself, with or without line breaks."""
        return rng.choice(["<br><br>", "<br>", "<hr>"]).join(text(1, 2, rng.choice([6, 12, 60]), rng.random() < 0.6) for _ in range(rng.randint(1, 3)))

    short = rng.random() < 0.3  # a notice, a note, a caption: one block or two
    if short:
        body = [rng.choice([bare, bare, lambda: f"<p>{text(1, 2, 10)}</p>", lambda: f"<p>{text(1, 2, 8, False)}", paragraph])() for _ in range(rng.choice([1, 1, 2]))]
    else:
        body = [paragraph() if rng.random() < 0.95 else bare() for _ in range(rng.randint(1, 14))]
    if rng.random() < (0.4 if short else 0.8):
        title = f"<h1>{text(1, 1, 12, False)}</h1>"
        body.insert(0, f"<header>{title}</header>" if rng.random() < 0.2 else title)
    for part in ("ad", "share", "comments", "sidebar", "notice"):
        if rng.random() < 0.25:
            body.insert(len(body) if part == "comments" else rng.randint(1, len(body)), frame(part))
    layout = rng.choice(["article", "article", "article", "main", "div", "div", "section", ""])
    inside = "".join(body)
    # Without an element of its own the content stands in the page as it is, in paragraphs of its own.
    middle = f"<{layout}{named('content', 1 if layout in ('div', 'section') else 0.4)}>{inside}</{layout}>" if layout else f"<hr>{inside}</p><hr>"
    if layout == "article" and rng.random() < 0.3:
        middle = f"<main{named('content', 0.3)}>{middle}</main>"
    alone = rng.random() < (0.3 if short else 0.05)  # the article is the whole page
    before = [frame(p) for p in ("notice", "header", "menu", "form", "ad", "sidebar") if rng.random() < 0.5 and not alone]
    after = [frame(p) for p in ("share", "sidebar", "ad", "comments", "form", "notice") if rng.random() < 0.35 and not alone]
    end = [frame("footer")] if rng.random() < 0.85 and not alone else []
    rng.shuffle(before)
    page = "".join([*before, middle, *after, *end])
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "wrap"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>", labels


def train(n_pages: int = 400, seed: int = 11) -> Field:
    rng, pages = random.Random(seed), []
    for _ in range(n_pages):
        page, labels = labelled_page(rng)
        found = blocks(page)
        given = [labels.get(b.text.removeprefix("© ")) for b in found]
        known = [k for k, y in enumerate(given) if y is not None]
        rows = features(found)
        pages.append(([rows[k] for k in known], [given[k] for k in known]))
    return Field.fit([p for p in pages if p[0]])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, field.decode(features(found))) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(vars(field or train()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(**shared.value)
        for batch in batches:
            texts = [main_text(h.as_py(), own) for h in batch.column("html")]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(task, rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
