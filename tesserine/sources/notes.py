"""A source for a notes service's recorded answers: one JSON file per page of the answer list."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow.fs import FileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What stands before the text of each kind of block.
PREFIX = {"paragraph": "", "heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}


def plain(parts: list[dict] | None) -> str:
    return "".join(p.get("plain_text", "") for p in parts or [])


def block_markdown(block: dict) -> str:
    kind = block.get("type", "")
    data = block.get(kind) or {}
    text = plain(data.get("rich_text"))
    if kind in PREFIX:
        return PREFIX[kind] + text
    match kind:
        case "to_do":
            return f"- [{'x' if data.get('checked') else ' '}] {text}"
        case "toggle":
            return f"<details><summary>{text}</summary></details>"
        case "code":
            return f"```{data.get('language', '')}\n{text}\n```"
        case "callout":
            return f"> {(data.get('icon') or {}).get('emoji', '')} {text}"
        case "divider":
            return "---"
        case "image":
            url = next((data[k]["url"] for k in ("file", "external") if (data.get(k) or {}).get("url")), "")
            return f"![{plain(data.get('caption'))}]({url})" if url else ""
    return ""


def page_title(page: dict) -> str:
    return next((plain(p.get("title")) for p in page.get("properties", {}).values() if p.get("type") == "title"), "Untitled")


class NotesSource(DataSource):
    """``spark.read.format("notes").option("files", "a.json,b.json")``: page_id, title, content_md."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "page_id string, title string, content_md string"

    def reader(self, schema) -> DataSourceReader:
        return NotesReader(self.options["files"].split(","))


class NotesReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, path = FileSystem.from_uri(partition.value)
        with system.open_input_stream(path) as f:
            answer = json.loads(f.read())
        for page in answer["results"]:
            text = "\n\n".join(t for t in map(block_markdown, page.get("children", [])) if t)
            yield page.get("id"), page_title(page), text
