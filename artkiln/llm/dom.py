"""Main-text extraction with a tree-structured graphical model.

Every block element of a page is a node with two states, main text or not.
Node potentials come from tag, attribute words, length and share of links,
parent-child potentials from the two states. Both are fitted to labelled
pages by the likelihood of their labels. Sum-product messages, once up and
once down the tree, give each node's exact marginal, in training as in use,
and the text of nodes that are more likely main text than not is kept.
"""

from __future__ import annotations

import html as html_
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom_pages import pages as labelled_pages

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr del acronym picture source".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Starting one of the right closes an open one of the left, no further out than the bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: A quote opens a value right after "=" only; an unquoted value ends at white space or ">".
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)|[^>=])*+)>|<[/!?a-zA-Z][^<>]*\Z", re.S)
_NAMES = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Steps, step size and pull towards 0 of the training.
STEPS, RATE, DECAY = 300, 0.5, 0.0001


class Node:
    __slots__ = ("tag", "parent", "inside", "names", "mark", "words", "linked", "below", "below_linked")

    def __init__(self, tag: str, parent: int, inside: str, names: tuple[str, ...], mark: str | None) -> None:
        self.tag, self.parent, self.inside, self.names, self.mark = tag, parent, inside, names, mark
        self.words = self.linked = self.below = self.below_linked = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents first, and the text in page order as (node, raw text); (node, "") where a block begins or ends."""
    nodes, flow = [Node("", -1, "", (), None)], []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements, inline ones with the node they stand in
    links, at, n = 0, 0, len(html)

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag, node = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                flow.append((nodes[node].parent, ""))

    def text(piece: str) -> None:
        if piece:
            node = nodes[stack[-1][1]]
            count = len(piece.split())
            node.words += count
            node.linked += count if links else 0
            flow.append((stack[-1][1], piece))

    while at < n:
        found = _MARKUP.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        ending, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in IMPLIED:
            shut, bound = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bound:
                    break
                if stack[k][0] in shut:
                    close(k)
        if tag in INLINE:
            if tag == "br":
                flow.append((stack[-1][1], " "))
            elif tag not in VOID:
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
        else:
            names, mark = [], None
            for key, *value in _NAMES.findall(rest) if rest else ():
                value = "".join(value)
                if key.lower() == "data-main":
                    mark = value
                else:
                    names += [w.lower() for w in _WORD.findall(value)]
            parent = stack[-1][1]
            nodes.append(Node(tag, parent, nodes[parent].tag, tuple(dict.fromkeys(names)), mark))
            flow.append((len(nodes) - 1, ""))
            if tag in VOID:
                flow.append((parent, ""))
            elif tag in RAW:
                stop = re.compile(f"</{tag}", re.I).search(html, at)
                at = stop.start() if stop else n
                stack.append((tag, len(nodes) - 1))
            else:
                stack.append((tag, len(nodes) - 1))
    for node in nodes:
        node.below, node.below_linked = node.words, node.linked
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.below += node.below
        up.below_linked += node.below_linked
    return nodes, flow


def clues(node: Node) -> list[str]:
    """Features of a node."""
    share = node.below_linked / node.below if node.below else 0
    return ["any", f"tag {node.tag}", f"{node.tag} in {node.inside}", f"length {min(4, int(math.log2(node.words + 1) / 1.6))}", f"links {0 if share < 0.2 else 1 if share < 0.6 else 2}", *[f"name {w}" for w in node.names]]


class Model:
    """Log potentials: of a clue for main text, and of each pair of parent and child state."""

    def __init__(self, pages: list[str], steps: int = STEPS) -> None:
        self.clue: dict[str, float] = defaultdict(float)
        self.edge = [[0.5, -0.5], [-0.5, 0.5]]
        cases = []
        for page in pages:
            nodes, _ = parse(page)
            state: list[int] = []
            for node in nodes:
                state.append(int(node.mark) if node.mark else state[node.parent] if node.parent >= 0 else 0)
            cases.append((nodes, [clues(v) for v in nodes], state))
        total, push = sum(len(c[0]) for c in cases), defaultdict(float)
        for _ in range(steps):
            step, turn = defaultdict(float), [[0.0, 0.0], [0.0, 0.0]]
            for nodes, seen, state in cases:
                belief, pairs = self.marginals(nodes, seen)
                for i in range(1, len(nodes)):
                    for c in seen[i]:
                        step[c] += state[i] - belief[i]
                    turn[state[nodes[i].parent]][state[i]] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            turn[a][b] -= pairs[i][a][b]
            for c, g in step.items():
                push[c] += (g / total) ** 2
                self.clue[c] += RATE * (g / total - DECAY * self.clue[c]) / (1e-4 + math.sqrt(push[c]))
            for a in (0, 1):
                for b in (0, 1):
                    self.edge[a][b] += RATE * (2 * turn[a][b] / total - DECAY * self.edge[a][b])
        self.clue = dict(self.clue)

    def marginals(self, nodes: list[Node], seen: list[list[str]]) -> tuple[list[float], list]:
        """Probability of main text for each node and of each pair of states on its edge to the parent.

        Messages go from the leaves to the root and back. All of them are odds of main text; the root is none.
        """
        (p00, p01), (p10, p11) = [[math.exp(x) for x in row] for row in self.edge]
        weight = self.clue.get
        up = [math.exp(max(-30.0, min(30.0, sum([weight(c, 0.0) for c in one])))) for one in seen]
        up[0] = 1e-9
        message = [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b = up[i]
            message[i] = (p10 + p11 * b) / (p00 + p01 * b)
            p = nodes[i].parent
            up[p] = min(1e30, max(1e-30, up[p] * message[i]))
        belief, pairs = [up[0]] * len(nodes), [None] * len(nodes)
        for i in range(1, len(nodes)):
            rest = belief[nodes[i].parent] / message[i]
            belief[i] = min(1e30, max(1e-30, up[i] * (p01 + p11 * rest) / (p00 + p10 * rest)))
            b = up[i]
            z = p00 + p01 * b + rest * (p10 + p11 * b)
            pairs[i] = ((p00 / z, p01 * b / z), (rest * p10 / z, rest * p11 * b / z))
        return [b / (1 + b) for b in belief], pairs

    def extract(self, html: str) -> str:
        """Main text: blocks in page order, one on a line, single spaces inside, references decoded."""
        nodes, flow = parse(html)
        main = [m > 0.5 for m in self.marginals(nodes, [clues(v) for v in nodes])[0]]
        blocks, held = [], []
        for node, piece in [*flow, (0, "")]:
            if piece:
                if main[node]:
                    held.append(piece)
            elif held:
                block = " ".join(html_.unescape("".join(held)).split())
                if block:
                    blocks.append(block)
                held = []
        return "\n".join(blocks)


def trained(pages: list[str] | None = None) -> Model:
    return Model(labelled_pages() if pages is None else pages)


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty page has an empty text, and rows that repeat stay rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.extract(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
