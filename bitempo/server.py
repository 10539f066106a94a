"""A tool server: JSON-RPC, one message a line, over the commands."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from bitempo.commands import Session, hit_line, review_line, words
from bitempo.operators.recall import Query

#: JSON-RPC error codes, protocol revisions and metadata keys.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, UNSUPPORTED_VERSION = -32700, -32600, -32601, -32602, -32022
MODERN = "2026-07-28"
LEGACY = ("2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05")
STRUCTURED_FROM = "2025-06-18"
VERSION_KEY = "io.modelcontextprotocol/protocolVersion"
CAPABILITIES_KEY = "io.modelcontextprotocol/clientCapabilities"
SERVER_KEY = "io.modelcontextprotocol/serverInfo"

SERVER = {"name": "bitempo", "title": "bitempo", "version": "1"}
ABOUT = "An append-only memory with two time axes. Ask about entities; answers keep a value, a stated absence and silence apart."


def _tool(name: str, title: str, description: str, required: list[str], **properties) -> dict:
    return {"name": name, "title": title, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}}


def _field(kind: str, description: str, **more) -> dict:
    return {"type": kind, "description": description, **more}


TOOLS = [
    _tool("remember", "Remember a turn", "Append what a turn of dialogue states; what it contradicts stays beside it.", ["text"], text=_field("string", "The whole turn."), speaker=_field("string", "Who said it."), session=_field("string", "Which conversation it belongs to.")),
    _tool("recall", "Recall assertions", "The assertions nearest to a text; those that later ones replaced are marked.", ["query"], query=_field("string", "What to look for."), k=_field("integer", "How many hits.", minimum=1)),
    _tool("about", "What is believed", "What an attribute of an entity held: a value, a stated absence, or nothing ever said.", ["entity", "attribute"], entity=_field("integer", "Its id.", minimum=0), attribute=_field("string", "Which attribute."), valid_at=_field("integer", "Epoch milliseconds at which it held."), as_of=_field("integer", "Epoch milliseconds at which it was known.")),
    _tool("reviews", "Open questions", "Pairs of entities too close to call; none of them is merged.", []),
    _tool("resolve_review", "Answer an open question", "Merge the pair, or settle it as different.", ["id", "same"], id=_field("integer", "The review.", minimum=0), same=_field("boolean", "Whether both are one.")),
]
MUTATING = ("remember", "resolve_review")
KINDS = {"string": lambda x: isinstance(x, str), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool)}


class Refused(ValueError):
    """A call that its schema does not allow; the text goes back to the caller."""


def read(name: str, arguments: dict, now: int) -> dict:
    """A tool's arguments, checked against its schema and with the defaults filled in."""
    schema = next(t for t in TOOLS if t["name"] == name)["inputSchema"]
    for field in schema["required"]:
        if field not in arguments:
            raise Refused(f"{field} is required")
    for field, value in arguments.items():
        rule = schema["properties"].get(field)
        if rule is None or value is None and field not in schema["required"]:
            continue
        if not KINDS[rule["type"]](value):
            raise Refused(f"{field} must be of type {rule['type']}")
        if rule["type"] == "string" and field in schema["required"] and not value.strip():
            raise Refused(f"{field} was empty")
        if "minimum" in rule and value < rule["minimum"]:
            raise Refused(f"{field} must be at least {rule['minimum']}")
    defaults = {"remember": {"session": "mcp", "speaker": None}, "recall": {"k": 5}, "about": {"valid_at": now, "as_of": now}}.get(name, {})
    return {f: v for f, v in {**defaults, **{f: v for f, v in arguments.items() if v is not None}}.items() if f in schema["properties"]}


def error(id_, code: int, message: str, data=None) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message, **({"data": data} if data is not None else {})}}


class Server:
    """Answers one line at a time; every call opens the store anew, so other writers are seen."""

    def __init__(self, session: Session):
        self.session, self.agreed = session, None

    def serve(self, lines: Iterable[str], out, clock: Callable[[], int]) -> None:
        for line in lines:
            if line.strip():
                answer = self.handle(line, clock())
                if answer is not None:
                    out.write(answer + "\n")
                    out.flush()

    def handle(self, line: str, now: int) -> str | None:
        """The answer to a message; none to a notification."""
        answer = self._answer(line, now)
        return None if answer is None else json.dumps(answer)

    def _answer(self, line: str, now: int) -> dict | None:
        try:
            m = json.loads(line)
        except ValueError:
            return error(None, PARSE_ERROR, "Parse error")
        m = m if isinstance(m, dict) else {}
        id_ = m.get("id")
        if "id" in m and (isinstance(id_, bool) or not isinstance(id_, str | int | float)):
            return error(None, INVALID_REQUEST, "Invalid Request: id must be a string or a number")
        if m.get("jsonrpc") != "2.0":
            return error(id_, INVALID_REQUEST, 'Invalid Request: jsonrpc must be "2.0"')
        if not isinstance(m.get("method"), str):
            return error(id_, INVALID_REQUEST, "Invalid Request: method must be a string")
        if "id" not in m:
            return None
        params = m.get("params") if isinstance(m.get("params"), dict) else {}
        meta = params.get("_meta") if isinstance(params.get("_meta"), dict) else {}
        asked = meta.get(VERSION_KEY) if m["method"] != "initialize" else None
        modern = isinstance(asked, str)
        if modern and asked != MODERN:
            return error(id_, UNSUPPORTED_VERSION, "Unsupported protocol version", {"supported": [MODERN], "requested": asked})
        if modern and CAPABILITIES_KEY not in meta:
            return error(id_, INVALID_PARAMS, f'Invalid params: _meta["{CAPABILITIES_KEY}"] is required')
        if m["method"] == "initialize":
            wanted = params.get("protocolVersion")
            self.agreed = wanted if wanted in LEGACY else LEGACY[0]
            result = {"protocolVersion": self.agreed, "capabilities": {"tools": {}}, "serverInfo": SERVER, "instructions": ABOUT}
        elif m["method"] == "server/discover":
            result = {"resultType": "complete", "supportedVersions": [MODERN], "capabilities": {"tools": {}}, "instructions": ABOUT, "_meta": {SERVER_KEY: SERVER}}
        elif m["method"] == "ping":
            result = self._shaped({}, modern)
        elif m["method"] == "tools/list":
            result = self._shaped({"tools": TOOLS}, modern)
        elif m["method"] == "tools/call":
            name, arguments = params.get("name"), params.get("arguments", {})
            if not isinstance(name, str):
                return error(id_, INVALID_PARAMS, "Invalid params: name is required and must be a string")
            if name not in {t["name"] for t in TOOLS}:
                return error(id_, INVALID_PARAMS, f"Unknown tool: {name}")
            result = self._shaped(self._call(name, arguments if isinstance(arguments, dict) else {}, now, modern), modern)
        else:
            return error(id_, METHOD_NOT_FOUND, f"Method not found: {m['method']}")
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    def _shaped(self, result: dict, modern: bool) -> dict:
        return {"resultType": "complete", **result, "_meta": {SERVER_KEY: SERVER}} if modern else result

    def _call(self, name: str, arguments: dict, now: int, modern: bool) -> dict:
        """What a tool answers; what the library refuses is a result too, for the caller to mend."""
        s = self.session
        try:
            a = read(name, arguments, now)
            if name == "remember":
                data = s.remember(a["text"], now, a["session"], a["speaker"])
                text = f"{len(data['mentions'])} mentions, {data['versions']} versions"
            elif name == "recall":
                data = {"hits": s.recall(a["query"], Query(a["k"]))}
                text = "\n".join(hit_line(h) for h in data["hits"]) or "nothing is known"
            elif name == "about":
                data = s.about(a["entity"], a["attribute"], a["valid_at"], a["as_of"])
                text = words(**data)
            elif name == "reviews":
                data = {"reviews": s.reviews()}
                text = "\n".join(review_line(r) for r in data["reviews"]) or "no open questions"
            else:
                data = s.settle(a["id"], a["same"])
                text = f"merged into {data['survivor']}" if "survivor" in data else "settled as different"
        except (ValueError, RuntimeError) as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        out = {"content": [{"type": "text", "text": text}], "isError": False}
        if modern or (self.agreed or LEGACY[0]) >= STRUCTURED_FROM:
            out["structuredContent"] = data
        return out
