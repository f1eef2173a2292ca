"""Analyzer property lists as rows: an event parser hands entries on while it reads, so no tree of a report is built."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa

#: Bytes given to the parser at once, and rows handed on at once.
CHUNK = 1 << 16
ROWS = 4096
TEXTS = ("description", "issue_context", "issue_context_kind")
ENTRY_SCHEMA = "report string, ord long, source_file string, line long, " + ", ".join(f"{c} string" for c in TEXTS)
_ARROW = pa.schema(
    [("report", pa.string()), ("ord", pa.int64()), ("source_file", pa.string()), ("line", pa.int64())] + [(c, pa.string()) for c in TEXTS]
)
_SCALARS = {"string", "integer", "real", "date", "data", "true", "false"}


class _Events:
    """Follows the path of keys through dicts and arrays; keeps listed files or diagnostics until they are taken."""

    def __init__(self, section: str):
        self.section, self.found = section, []
        self.kinds, self.keys, self.text, self.item = [], [], [], None
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler = self.text.append
        self.parser.EntityDeclHandler = self.entity

    def entity(self, *_) -> None:
        raise ValueError("entities are not allowed")

    def value_begins(self) -> None:
        if self.kinds and self.kinds[-1] == "dict" and self.keys[-1] is None:
            raise ValueError("value without a key")

    def value_ended(self, value=None) -> None:
        """A value stands at the path ``keys``; only those of the wanted section are kept."""
        if self.kinds[:2] == ["dict", "array"] and self.keys[0] == self.section:
            inner = self.keys[2:]
            if not inner:
                self.found.append(value if self.section == "files" else self.item or {})
                self.item = None
            elif self.item is not None and value is not None and self.kinds[2:] in (["dict"], ["dict", "dict"]):
                self.item[".".join(inner)] = value
        if self.kinds and self.kinds[-1] == "dict":
            self.keys[-1] = None

    def start(self, name: str, _) -> None:
        self.text.clear()
        if name in ("dict", "array"):
            self.value_begins()
            self.kinds.append(name)
            self.keys.append(None)
            if self.section == "diagnostics" and self.kinds == ["dict", "array", "dict"] and self.keys[0] == "diagnostics":
                self.item = {}

    def end(self, name: str) -> None:
        text = "".join(self.text)
        self.text.clear()
        if name == "key":
            if not self.kinds or self.kinds[-1] != "dict" or self.keys[-1] is not None:
                raise ValueError("key out of place")
            self.keys[-1] = text
        elif name in ("dict", "array"):
            if self.keys.pop() is not None:
                raise ValueError("key without a value")
            self.kinds.pop()
            self.value_ended()
        elif name in _SCALARS:
            self.value_begins()
            self.value_ended(int(text, 16 if "0x" in text.lower() else 10) if name == "integer" else text)

    def read(self, content: bytes) -> Iterator:
        """What the section holds, item by item."""
        for at in range(0, len(content), CHUNK):
            self.parser.Parse(content[at : at + CHUNK], False)
            yield from self.found
            self.found.clear()
        self.parser.Parse(b"", True)
        yield from self.found


def _tree_diagnostics(tree: dict) -> Iterator[dict]:
    for d in tree.get("diagnostics", []):
        yield {**d, **{f"location.{k}": v for k, v in d.get("location", {}).items()}}


def plist_entries(report: str, content: bytes) -> Iterator[tuple]:
    """The rows of one report, listed files first; none if it is broken anywhere.

    The first pass checks the whole text and keeps the listed paths, the second hands diagnostics on one by one, as they
    stand before the paths they point to. Binary property lists, which have no events, are loaded.
    """
    try:
        if content.startswith(b"bplist"):
            tree = plistlib.loads(content)
            files, diagnostics = [str(f) for f in tree.get("files", [])], list(_tree_diagnostics(tree))
        else:
            files, diagnostics = list(_Events("files").read(content)), _Events("diagnostics").read(content)
    except (expat.ExpatError, ValueError, AttributeError, TypeError, plistlib.InvalidFileException):
        return
    for n, path in enumerate(files):
        yield report, n, path, None, None, None, None
    for d in diagnostics:
        at, line = d.get("location.file"), d.get("location.line")
        listed = isinstance(at, int) and 0 <= at < len(files)
        texts = [None if (v := d.get(c)) is None else str(v) for c in TEXTS]
        yield report, None, (files[at] or "") if listed else "", line if isinstance(line, int) and abs(line) < 1 << 63 else None, *texts


def plist_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(report, content) to entries, at most ``ROWS`` at once whatever a report holds."""
    held = []

    def handed_on() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for batch in batches:
        for report, content in zip(batch.column("report"), batch.column("content")):
            for entry in plist_entries(report.as_py(), content.as_py() or b""):
                held.append(entry)
                if len(held) == ROWS:
                    yield handed_on()
    if held:
        yield handed_on()
