"""The tools for an agent: JSON-RPC messages, one a line, over standard input and output."""

from __future__ import annotations

import inspect
import json
import sys
from typing import IO, Any

from . import __version__
from .api import TOOL_NAMES, Tools

PROTOCOL = "2024-11-05"
_TYPES = {"str": {"type": "string"}, "int": {"type": "integer"}, "list": {"type": "array", "items": {"type": "string"}}}


def describe(tools: Tools) -> list[dict[str, Any]]:
    """Name and input schema of each tool, from its signature."""
    out = []
    for name in TOOL_NAMES:
        parameters = inspect.signature(getattr(tools, name)).parameters
        schema = {k: _TYPES[str(p.annotation).split("[")[0].split(" ")[0]] for k, p in parameters.items()}
        required = [k for k, p in parameters.items() if p.default is p.empty]
        out.append({"name": name, "inputSchema": {"type": "object", "properties": schema, "required": required}})
    return out


def answer(tools: Tools, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to a message, None to a notification."""
    method, params = message.get("method", ""), message.get("params") or {}
    if "id" not in message:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        reply["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": __version__}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": describe(tools)}
    elif method == "tools/call" and params.get("name") in TOOL_NAMES:
        try:
            envelope = getattr(tools, params["name"])(**(params.get("arguments") or {}))
        except TypeError as e:  # missing or unknown arguments
            reply["error"] = {"code": -32602, "message": str(e)}
        else:
            text = json.dumps(envelope.document(), ensure_ascii=False)
            reply["result"] = {"content": [{"type": "text", "text": text}], "isError": not envelope.ok}
    else:
        reply["error"] = {"code": -32601, "message": f"no such method or tool: {params.get('name') or method}"}
    return reply


def serve(tools: Tools, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    serve(Tools(SparkSession.builder.appName("weftgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()))
