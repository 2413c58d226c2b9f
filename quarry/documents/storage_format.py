"""Wiki pages in storage format: macros, images, links and tasks become HTML that any page has, then Markdown.

One pass over a page's tokens with a stack of open elements. An element that means something here is a frame
that gathers its own parameters, attachment and body; when it closes, what it stands for goes to the frame
around it. So macros in macros are rewritten from the inside out, whatever their depth, and a macro that
is never closed ends with what encloses it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.udfs import html_to_markdown

# Names of macros and elements, file endings, marks and words of the visible form.
VIDEO_ENDINGS = (".mp4", ".mov", ".avi", ".wmv", ".webm", ".mkv", ".flv", ".m4v")
NOTICES = {"info": "ℹ️ ", "note": "📝 ", "warning": "⚠️ ", "tip": "💡 "}
GONE = ("toc", "children", "include", "excerpt-include", "recently-updated", "livesearch", "jira")
EXPAND_TITLE, STATUS_TITLE, EMPTY_PAGE = "펼치기", "STATUS", "(빈 페이지)"
CHECKED, UNCHECKED = "☑", "☐"

_TOKEN = re.compile(
    r"<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'/>]+))")
_TAG = re.compile(r"<[^>]*>")
#: Pages of a batch that are held as Python's texts together.
AT_ONCE = 64
#: Elements that gather what is in them; others pass through as they are.
_FRAMES = {
    "ac:structured-macro", "ac:parameter", "ac:rich-text-body", "ac:plain-text-body", "ac:image", "ac:caption", "ac:link", "ac:link-body", "ac:plain-text-link-body",
    "ac:task-list", "ac:task", "ac:task-id", "ac:task-status", "ac:task-body", "ac:placeholder",
}
_EMPTY = {"ri:attachment", "ri:url", "ri:page", "ri:user", "ac:emoticon", "br", "hr", "img", "input", "meta", "link", "col"}


@dataclass
class _Frame:
    name: str
    attrs: dict[str, str]
    in_cell: bool
    out: list[str] = field(default_factory=list)
    #: What elements inside have told: parameters by name, bodies, the attachment, page or address that is meant, rows of tasks.
    told: dict = field(default_factory=dict)

    def text(self) -> str:
        return html.unescape(_TAG.sub("", "".join(self.out)))


class _Page:
    def __init__(self):
        self.stack = [_Frame("", {}, False)]
        self.tags: list[list[str]] = [[]]  # open elements that pass through, for each frame
        self.images: list[str] = []
        self.videos: list[str] = []

    def read(self, page: str) -> str:
        for token in _TOKEN.finditer(page):
            if token["raw"] is not None:
                self.put(html.escape(token["raw"], quote=False))
            elif token["text"] is not None:
                self.put(token["text"] if token["text"] != "<" else "&lt;")
            elif token["name"] is not None:
                (self.close if token["end"] else self.open)(token["name"].lower(), token["attrs"], token[0])
        while len(self.stack) > 1:
            self.pop()
        return "".join(self.stack[0].out)

    def put(self, piece: str) -> None:
        self.stack[-1].out.append(piece)

    def open(self, name: str, attrs: str, whole: str) -> None:
        alone = attrs.rstrip().endswith("/")
        top = self.stack[-1]
        if name in _FRAMES:
            self.stack.append(_Frame(name, self.attributes(attrs), top.in_cell or any(t in ("td", "th") for t in self.tags[-1])))
            self.tags.append([])
            if alone:
                self.pop()
        elif name in _EMPTY and name[:3] in ("ri:", "ac:"):
            self.refer(name, self.attributes(attrs))
        else:
            self.put(whole)
            if not alone and name not in _EMPTY:
                self.tags[-1].append(name)

    def close(self, name: str, attrs: str, whole: str) -> None:
        if name in _FRAMES:
            if any(f.name == name for f in self.stack[1:]):
                while self.stack[-1].name != name:
                    self.pop()
                self.pop()
        elif name in _EMPTY:
            pass
        elif name in self.tags[-1]:
            while self.tags[-1].pop() != name:
                pass
            self.put(whole)
        elif len(self.stack) == 1 or any(name in tags for tags in self.tags[:-1]):
            # what encloses a frame ends: the frame wasn't closed
            while len(self.stack) > 1 and name not in self.tags[-1]:
                self.pop()
            if name in self.tags[-1]:
                self.close(name, attrs, whole)

    @staticmethod
    def attributes(attrs: str) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)}

    def refer(self, name: str, attrs: dict[str, str]) -> None:
        if name == "ri:user" and not any(f.name == "ac:parameter" for f in self.stack):
            self.put(f"<span>@{_safe(attrs.get('ri:account-id', 'user'))}</span>")
        elif name != "ac:emoticon":
            # what is meant belongs to the image, link or macro around it, through parameters and bodies
            for frame in reversed(self.stack[1:]):
                if frame.name in ("ac:image", "ac:link", "ac:structured-macro"):
                    frame.told.setdefault(name, attrs)
                    break

    def pop(self) -> None:
        frame, tags = self.stack.pop(), self.tags.pop()
        frame.out += [f"</{t}>" for t in reversed(tags)]
        around = self.stack[-1]
        if frame.name == "ac:parameter":
            around.told.setdefault(("parameter", frame.attrs.get("ac:name", "")), frame.text())
        elif frame.name in ("ac:rich-text-body", "ac:plain-text-body") and around.name == "ac:structured-macro":
            around.told.setdefault(frame.name, "".join(frame.out))
        elif frame.name in ("ac:caption", "ac:link-body", "ac:plain-text-link-body", "ac:task-status", "ac:task-body") and len(self.stack) > 1:
            around.told.setdefault("label" if frame.name.endswith("link-body") else frame.name, frame)
        elif frame.name == "ac:task" and around.name == "ac:task-list":
            status, body = (frame.told.get(k) for k in ("ac:task-status", "ac:task-body"))
            done = status is not None and status.text() == "complete"
            around.told.setdefault("tasks", []).append(f"<li>{CHECKED if done else UNCHECKED} {_safe(body.text()) if body else ''}</li>")
        elif frame.name == "ac:task-list":
            self.put(f"<ul>{''.join(frame.told.get('tasks', ()))}</ul>")
        elif frame.name == "ac:image":
            self.put(self.image(frame))
        elif frame.name == "ac:link":
            self.put(self.link(frame))
        elif frame.name == "ac:structured-macro":
            self.put(self.macro(frame))
        elif frame.name not in ("ac:placeholder", "ac:task-id", "ac:task-status", "ac:task", "ac:caption"):
            around.out += frame.out  # a body outside any macro is its content

    def image(self, frame: _Frame) -> str:
        meant, address, caption = frame.told.get("ri:attachment"), frame.told.get("ri:url"), frame.told.get("ac:caption")
        said = caption.text().strip() if caption else None
        if meant is not None:
            name = meant.get("ri:filename", "image.png")
            self.images.append(name)
            alt, src = name if said is None else said, f"images/{name}"
        elif address is not None:
            alt, src = "image" if said is None else said, address.get("ri:value", "")
        else:
            return ""
        if frame.in_cell:  # tables keep the Markdown form
            return _safe(f"![{alt}]({src})" + (f" *{said}*" if said is not None else ""))
        return f'<img src="{html.escape(src)}" alt="{html.escape(alt)}"/>' + (f"<p><em>{_safe(said)}</em></p>" if said else "")

    def link(self, frame: _Frame) -> str:
        page, meant, label = frame.told.get("ri:page"), frame.told.get("ri:attachment"), frame.told.get("label")
        if page is not None:
            target = page.get("ri:content-title", "")
            href = f"#{target}"
        elif meant is not None:
            target = meant.get("ri:filename", "")
            href = self.file(target)
        else:
            return "".join(label.out) if label else ""
        return f'<a href="{html.escape(href)}">{_safe((label.text() if label else "") or target)}</a>'

    def file(self, name: str) -> str:
        if name.lower().endswith(VIDEO_ENDINGS):
            self.videos.append(name)
            return f"videos/{name}"
        return f"images/{name}"

    def macro(self, frame: _Frame) -> str:
        kind, told = frame.attrs.get("ac:name", ""), frame.told
        parameter = lambda name: told.get(("parameter", name))
        rich, plain, meant = told.get("ac:rich-text-body"), told.get("ac:plain-text-body"), told.get("ri:attachment")
        if kind == "code":
            language = parameter("language")
            mark = f' class="language-{html.escape(language)}"' if language else ""
            return f"<pre><code{mark}>{plain or ''}</code></pre>"
        if kind in ("multimedia", "view-file"):
            if meant is None:
                return ""
            name = meant.get("ri:filename", "media")
            at = self.file(name)
            if at.startswith("images/"):
                self.images.append(name)
            return f"<p>{_safe(f'[{"VIDEO" if at.startswith("videos/") else "FILE"}: {name}]({at})')}</p>"
        if kind == "widget":
            return f"<p>{_safe(f'[EMBED: {url}]({url})')}</p>" if (url := parameter("url")) else ""
        if kind == "status":
            return f"<span>[{_safe(parameter('title') or STATUS_TITLE)}]</span>"
        if kind in GONE:
            return ""
        if rich is None:
            known = kind in NOTICES or kind in ("panel", "expand", "excerpt")
            return f"<pre>{plain}</pre>" if plain is not None and not known else ""
        if kind in NOTICES:
            return f"<blockquote><p>{NOTICES[kind]}</p>{rich}</blockquote>"
        if kind == "panel":
            title = parameter("title")
            return f"<blockquote>{f'<p><strong>{_safe(title)}</strong></p>' if title else ''}{rich}</blockquote>"
        if kind == "expand":
            return f"<details><summary>{_safe(parameter('title') or EXPAND_TITLE)}</summary>{rich}</details>"
        return rich if kind == "excerpt" else f"<div>{rich}</div>"


def _safe(text: str) -> str:
    return html.escape(text, quote=False)


def macros_to_html(pages: Column | str) -> Column:
    """Struct (html, images, videos): pages without what only the wiki knows, and the names of attached images and videos in order.

    Code, notices, panels, expanded parts, labels of state, media, embedded pages, excerpts, images with captions, links and tasks become
    plain elements; lists of contents and other pages go, macros that aren't known leave their body. A parameter belongs to its own macro.
    What is never closed ends with what encloses it, an end without a beginning is passed over. Text that is
    raw is escaped. Null pages have no html and no names.
    """

    kind = pa.struct([("html", pa.string()), ("images", pa.list_(pa.string())), ("videos", pa.list_(pa.string()))])

    def read(text: str | None) -> dict:
        page = _Page()
        return {"html": None if text is None else page.read(text), "images": page.images, "videos": page.videos}

    def each(texts: pa.Array) -> pa.Array:
        # only a few pages at a time are Python's; the rest of a batch is packed
        done = [pa.array([read(t.as_py()) for t in texts.slice(at, AT_ONCE)], kind) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return F.arrow_udf(each, "html string, images array<string>, videos array<string>")(pages)


def to_markdown(page_html: Column, title: Column | None = None) -> Column:
    """Markdown of a page that ``macros_to_html`` gave, under its title if there is one; an empty page says that it is."""
    said = html_to_markdown(F.coalesce(page_html, F.lit("")))
    body = F.concat(F.when(F.trim(F.coalesce(page_html, F.lit("")), F.lit(" \t\r\n")) == "", EMPTY_PAGE).otherwise(said), F.lit("\n"))
    if title is None:
        return body
    return F.concat(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), body)
