"""Command line: index a repository, show its status, answer queries over stdio."""

from __future__ import annotations

import argparse
import inspect
import json
import os
import sys

from pyspark.sql import SparkSession

from . import api
from . import schemas as S
from .plans import index
from .session import ship
from .sources import repository


_KINDS = {"str": "string", "int": "integer"}
_BOUNDS = {"limit": S.LIMIT, "depth": S.DEPTH, "max_depth": S.DEPTH, "min_size": S.MIN_SIZE, "window_days": S.WINDOW_DAYS}
_CHOICES = {"direction": ["in", "out"], "scope": ["module", "file"], "min_confidence": list(reversed(S.CONFIDENCES))}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def schema_of(tool: str) -> dict:
    """A tool's name, description and the JSON schema of its arguments, read off its method."""
    method = getattr(api.Repository, tool)
    properties = {"repo": {"type": "string", "description": "path of the checkout; the working directory where left out"}}
    required = []
    for name, p in list(inspect.signature(method).parameters.items())[1:]:
        entry: dict = {"type": _KINDS[str(p.annotation).split(" ")[0]]}
        if name in _BOUNDS:
            entry |= {"minimum": _BOUNDS[name][0], "maximum": _BOUNDS[name][1]}
        if name in _CHOICES:
            entry["enum"] = _CHOICES[name]
        if name == "kind":
            entry["enum"] = list(S.SYMBOL_KINDS if tool == "search_code" else S.EDGE_KINDS)
        if p.default is inspect.Parameter.empty:
            required.append(camel(name))
            entry["minLength"] = 1
        elif p.default is not None:
            entry["default"] = p.default
        properties[camel(name)] = entry
    return {"name": tool, "description": inspect.getdoc(method), "inputSchema": {"type": "object", "properties": properties, "required": required}}


def arguments_of(tool: str, given: dict) -> dict:
    """The method's arguments from a request's, named in either style."""
    names = list(inspect.signature(getattr(api.Repository, tool)).parameters)[1:]
    known = {camel(n): n for n in names} | {n: n for n in names}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown arguments: {', '.join(unknown)}")
    return {known[k]: v for k, v in given.items() if v is not None}


def respond(spark: SparkSession, home: str, request: dict) -> dict | None:
    """One JSON-RPC request: initialize, tools/list or tools/call; notifications have no answer."""
    method, params, rid = request.get("method"), request.get("params") or {}, request.get("id")
    if rid is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1"}}
        elif method == "tools/list":
            result = {"tools": [schema_of(t) for t in api.TOOLS]}
        elif method == "tools/call":
            if params.get("name") not in api.TOOLS:
                raise ValueError(f"no such tool: {params.get('name')}")
            arguments = dict(params.get("arguments") or {})
            root = os.path.abspath(arguments.pop("repo", None) or ".")
            arguments = arguments_of(params["name"], arguments)
            repo = api.Repository(spark, root, repository.index_dir(root, home))
            result = {"content": [{"type": "text", "text": api.to_json(getattr(repo, params["name"])(**arguments))}]}
        else:
            return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32601, "message": f"no such method: {method}"}}
    except (ValueError, TypeError, index.IndexError_) as e:
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32602, "message": str(e)}}
    except Exception as e:  # noqa: BLE001  one failed request must not end the server
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32603, "message": f"{type(e).__name__}: {str(e)[:500]}"}}
    return {"jsonrpc": "2.0", "id": rid, "result": result}


def serve(spark: SparkSession, home: str, lines, write) -> None:
    """Answers each line of JSON-RPC; a malformed one gets an error and the next is read."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
        except ValueError as e:
            answer: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        else:
            answer = respond(spark, home, request)
        if answer is not None:
            write(json.dumps(answer))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--home", default=os.path.expanduser("~/.graphloom"))
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "status"):
        sub = commands.add_parser(name)
        sub.add_argument("repo", nargs="?", default=".")
        if name == "index":
            sub.add_argument("--full", action="store_true", help="rebuild from scratch")
    commands.add_parser("serve")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    ship(spark)
    if args.command == "serve":
        serve(spark, args.home, sys.stdin, lambda text: print(text, flush=True))
        return 0
    root = os.path.abspath(args.repo)
    home = repository.index_dir(root, args.home)
    if args.command == "index":
        print(json.dumps(index.build(spark, root, home) if args.full else index.refresh(spark, root, home)))
    state, delta = index.freshness(spark, root, home)
    print(f"{root}: {state}, {delta} changed files")
    if state in ("stale", "current"):
        meta = index.load(spark, home).meta
        print(f"{meta['files_indexed']} files indexed, {meta['files_skipped']} skipped")
        for reason, n in sorted(json.loads(meta["files_skipped_by_reason"]).items()):
            print(f"  {reason}: {n}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
