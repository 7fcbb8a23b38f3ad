"""Another engine's web service as a source: requests by an exchangeable transport, answers as objects, faults as codes."""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

# Which code a status of the service means, and how long an answer may take.
CODES = {400: "invalid_parameters", 422: "invalid_parameters", 404: "not_found", 409: "index_not_ready"}
READ_SECONDS, ANSWER_SECONDS = 60.0, 180.0

#: (method, address, body or None, seconds) to (status, body).
Transport = Callable[[str, str, bytes | None, float], tuple[int, bytes]]


class ServiceError(RuntimeError):
    """A fault of the service; ``code`` says which, and nothing of its inner texts is passed on."""

    def __init__(self, code: str, status: int | None = None):
        super().__init__(code if status is None else f"{code} (HTTP {status})")
        self.code, self.status = code, status


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def direct(method: str, address: str, body: bytes | None, seconds: float) -> tuple[int, bytes]:
    """Requests without proxies or redirects."""
    request = urllib.request.Request(address, body, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({}), _NoRedirects).open(request, timeout=seconds) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""
    except urllib.error.URLError as e:
        raise (TimeoutError() if isinstance(e.reason, socket.timeout) else ConnectionError()) from e


class Service:
    def __init__(self, address: str, transport: Transport = direct):
        parts = urllib.parse.urlsplit(address)
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.query or parts.fragment:
            raise ValueError("an http or https address without a query is needed")
        self.address, self.transport = address.rstrip("/"), transport

    def ask(self, method: str, path: str, query: dict | None = None, body: dict | None = None, seconds: float = READ_SECONDS) -> dict:
        where = f"{self.address}/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        try:
            status, said = self.transport(method, where, None if body is None else json.dumps(body).encode(), seconds)
        except TimeoutError as e:
            raise ServiceError("timeout") from e
        except OSError as e:
            raise ServiceError("service_unavailable") from e
        if not 200 <= status < 300:
            raise ServiceError(CODES.get(status, "service_unavailable"), status)
        try:
            out = json.loads(said)
        except ValueError as e:
            raise ServiceError("invalid_response") from e
        if not isinstance(out, dict):
            raise ServiceError("invalid_response")
        return out

    def search(self, question: str, top_k: int = 10, as_of: str | None = None) -> dict:
        return self.ask("GET", "policy-search", {"q": question, "top_k": top_k} | ({"as_of": as_of} if as_of else {}))

    def policies(self, text: str = "", status: str = "", limit: int = 30, offset: int = 0) -> dict:
        return self.ask("GET", "api/policies", {"q": text, "status": status, "limit": limit, "offset": offset})

    def policy(self, policy_id: str) -> dict:
        return self.ask("GET", f"api/policies/{urllib.parse.quote(policy_id, safe='')}")

    def answer(self, question: str, as_of: str | None = None) -> dict:
        return self.ask("POST", "policy-answer", body={"question": question} | ({"as_of": as_of} if as_of else {}), seconds=ANSWER_SECONDS)
