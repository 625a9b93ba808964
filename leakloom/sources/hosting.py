"""Discovery of repositories through a hosting service's REST interface.

The driver pages through lists with a transport, ``(method, url, headers) -> (status, headers, body)``,
which tests replace; the rows become a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Transport = Callable[[str, str, dict], tuple[int, dict, bytes]]
PER_PAGE, TIMEOUT, ERROR_BYTES, FRESH_SECONDS = 100, 30, 4096, 600


def urllib_transport(method: str, url: str, headers: dict) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, method=method, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read(ERROR_BYTES)


def next_link(header: str) -> str | None:
    """The address of the next page in a Link header."""
    for part in header.split(","):
        m = re.match(r"\s*<([^>]*)>\s*;.*\brel=\"?next\"?", part)
        if m:
            return m[1]
    return None


def owner(target: str) -> str:
    """The owner that an address of the public host, or ``owner/name``, names; else empty."""
    u = urlsplit(target)
    if u.scheme and (u.hostname or "") not in ("github.com", "www.github.com"):
        return ""
    parts = [p for p in (u.path if u.scheme else target).split("/") if p]
    return parts[0] if len(parts) >= 2 else ""


def owner_of(target: Column) -> Column:
    """``owner`` as a column."""
    scheme = target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    path = F.when(scheme, F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?i:www\.)?(?i:github\.com)(?::[0-9]+)?(/[^?#]*)", 1)).otherwise(target)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.get(parts, 0)).otherwise(F.lit(""))


HOSTS = ("github.com", "www.github.com")


def is_remote(target: str) -> bool:
    """Whether a target is an address that can be cloned: http or https, of the public host, with owner and name."""
    u = urlsplit(target)
    return u.scheme in ("http", "https") and u.hostname in HOSTS and len([p for p in u.path.split("/") if p]) >= 2


@dataclass
class Client:
    token: str
    base: str = "https://api.github.com"
    transport: Transport = urllib_transport

    def pages(self, path: str) -> Iterator[object]:
        url: str | None = f"{self.base}{path}{'&' if '?' in path else '?'}per_page={PER_PAGE}"
        while url:
            status, headers, body = self.transport("GET", url, {"Authorization": f"Bearer {self.token}", "Accept": "application/vnd.github+json"})
            if status >= 300:
                raise RuntimeError(f"GET {path}: status {status}: {body[:ERROR_BYTES].decode('utf-8', 'replace').strip()}")
            yield json.loads(body)
            url = next_link({k.lower(): v for k, v in headers.items()}.get("link", ""))

    def rows(self, path: str, key: str | None = None) -> list[dict]:
        return [x for page in self.pages(path) for x in (page.get(key) or [] if key else page)]

    def organisation(self, org: str) -> list[dict]:
        return self.rows(f"/orgs/{org}/repos?type=all")

    def enterprise(self, name: str) -> list[str]:
        return [x["login"] for x in self.rows(f"/enterprises/{name}/organizations")]

    def enterprise_repositories(self, name: str) -> list[dict]:
        """The repositories of all organisations of an enterprise."""
        return [r for org in sorted(self.enterprise(name)) for r in self.organisation(org)]

    def installations(self) -> list[dict]:
        """The application's installations, by account and id; asked with the application's own token."""
        return sorted(self.rows("/app/installations"), key=lambda x: ((x.get("account") or {}).get("login") or "", x.get("id") or 0))

    def installation_token(self, installation: int | str) -> tuple[str, float | None]:
        """(token, when it expires) of an installation; asked with the application's own token."""
        path = f"/app/installations/{installation}/access_tokens"
        status, _, body = self.transport("POST", f"{self.base}{path}", {"Authorization": f"Bearer {self.token}", "Accept": "application/vnd.github+json"})
        if status >= 300:
            raise RuntimeError(f"POST {path}: status {status}: {body[:ERROR_BYTES].decode('utf-8', 'replace').strip()}")
        found = json.loads(body)
        at = found.get("expires_at")
        return found["token"], None if not at else datetime.fromisoformat(at.replace("Z", "+00:00")).timestamp()

    def accessible(self) -> list[dict]:
        """The installation's repositories, or the user's where that fails or is empty."""
        try:
            found = self.rows("/installation/repositories", "repositories")
        except RuntimeError:
            found = []
        return found or self.rows("/user/repos")


def repositories(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(idx, full_name, clone_url, private) in the order found; see ``state.last_by_name``."""
    data = [(i, r.get("full_name") or "", r.get("clone_url") or "", bool(r.get("private"))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "idx long, full_name string, clone_url string, private boolean")


@dataclass
class TokenCache:
    """Tokens by key, fetched again without an expiry or with less than ten minutes left."""

    fetch: Callable[[str], tuple[str, float | None]]
    now: Callable[[], float] = time.time
    held: dict[str, tuple[str, float | None]] = field(default_factory=dict)

    def get(self, key: str) -> str:
        own = self.held.get(key)
        if own is None or own[1] is None or own[1] - self.now() < FRESH_SECONDS:
            self.held[key] = own = self.fetch(key)
        return own[0]


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """(tag, content, place behind) of a DER element."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return tag, data[at : at + size], at + size


def read_key(pem: str) -> tuple[int, int]:
    """(modulus, private exponent) of an RSA key in PEM: PKCS#1, or PKCS#8 around it."""
    import base64

    m = re.search(r"-----BEGIN (RSA )?PRIVATE KEY-----(.*?)-----END (?:RSA )?PRIVATE KEY-----", pem, re.S)
    if not m:
        raise ValueError("no RSA private key in the file")
    try:
        data = base64.b64decode("".join(m[2].split()), validate=True)
        body, at, numbers = _der(data)[1], 0, []
        if not m[1]:
            at = _der(body, _der(body)[2])[2]  # behind version and algorithm
            body, at = _der(_der(body, at)[1])[1], 0
        while at < len(body) and len(numbers) < 4:
            _, value, at = _der(body, at)
            numbers.append(int.from_bytes(value, "big"))
    except (ValueError, IndexError) as e:
        raise ValueError("the private key can't be read") from e
    if len(numbers) < 4 or not numbers[1]:
        raise ValueError("the private key can't be read")
    return numbers[1], numbers[3]


def signer(pem: str) -> Callable[[bytes], bytes]:
    """RSASSA-PKCS1-v1_5 with SHA-256 by a key in PEM."""
    n, d = read_key(pem)
    size = (n.bit_length() + 7) // 8
    prefix = bytes.fromhex("3031300d060960864801650304020105000420")  # fixed value: what names SHA-256

    def sign(data: bytes) -> bytes:
        digest = prefix + hashlib.sha256(data).digest()
        padded = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
        return pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big")

    return sign


def clients(transport: Transport = urllib_transport, base: str = "https://api.github.com", token: str = "", app_id: str = "", key: str = "", installation: str = "", orgs: list[str] = (), every: bool = False, cache: TokenCache | None = None) -> list[tuple[str, Client]]:
    """(account, client) of what a scan may read: of a token alone (account ``""``); else of an application's
    installations: the one named, those of the organisations (whatever the case of their names), or all."""
    if token:
        return [("", Client(token, base, transport))]
    if not app_id or not key:
        return []
    app = lambda: Client(app_jwt(app_id, signer(key)), base, transport)
    cache = cache or TokenCache(lambda i: app().installation_token(i))
    if installation:
        return [("", Client(cache.get(str(installation)), base, transport))]
    own = [(str((x.get("account") or {}).get("login") or ""), str(x["id"])) for x in app().installations()]
    wanted = {o.lower() for o in orgs}
    if not every:
        missing = wanted - {account.lower() for account, _ in own}
        if missing:
            raise RuntimeError(f"the application isn't installed for {', '.join(sorted(missing))}")
        own = [x for x in own if x[0].lower() in wanted]
    return [(account, Client(cache.get(i), base, transport)) for account, i in own]


def app_claims(app_id: str, now: int) -> dict:
    """Claims of an application's token: issued a minute ago, valid for nine."""
    return {"iat": now - 60, "exp": now + 540, "iss": app_id}


def app_jwt(app_id: str, sign: Callable[[bytes], bytes], now: int | None = None) -> str:
    """A signed token (RS256); ``sign`` is the caller's RSA signature of the bytes."""
    import base64

    code = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=")
    body = b".".join(code(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "RS256", "typ": "JWT"}, app_claims(app_id, int(time.time()) if now is None else now)))
    return (body + b"." + code(sign(body))).decode()
