"""Connection addresses of databases: scheme://user:password@host:port,host:port/database?key=value."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

_PART = r"[^:@,/?=&]+"
_ADDRESS = re.compile(
    rf"\s*(?P<scheme>[^:]+)://(?:(?P<username>{_PART})(?::(?P<password>{_PART}))?@)?(?P<hosts>[^@/?=&]+)(?:/(?P<endpoint>{_PART})?)?(?:\?(?P<options>[^:@,/?]+)?)?\s*"
)
_DRIVERS = {"postgresql": "postgresql", "mysql": "mysql", "sql-server": "sqlserver"}


def parse(uri: str, scheme: str = "db") -> dict:
    """The parts of an address; those that are missing are None.  Another scheme, or none, is an error."""
    if "://" not in uri:
        raise ValueError(f"No scheme found in URI {uri}")
    m = _ADDRESS.fullmatch(uri)
    if m is None:
        return {}
    if scheme and m["scheme"] != scheme:
        raise ValueError(f"URI must start with '{scheme}://'")
    plain = lambda x: None if x is None else unquote(x)
    hosts = []
    for h in m["hosts"].split(","):
        name, colon, port = h.partition(":")
        hosts.append({"host": unquote(name), **({"port": int(port)} if colon else {})})
    options = None
    if m["options"]:
        options = {unquote(k): unquote(v) for k, _, v in (o.partition("=") for o in m["options"].split("&")) if k}
    return {"scheme": m["scheme"], "username": plain(m["username"]), "password": plain(m["password"]), "hosts": hosts, "endpoint": plain(m["endpoint"]), "options": options}


def build(parts: dict | None, scheme: str = "db") -> str:
    """An address of parts as :func:`parse` gives them."""
    if not parts:
        return f"{scheme}://localhost"
    if parts.get("scheme") and parts["scheme"] != scheme:
        raise ValueError(f"Scheme not supported: {parts['scheme']}")
    q = lambda x: quote(str(x), safe="!'()*~")
    user = ""
    if parts.get("username"):
        user = q(parts["username"]) + (f":{q(parts['password'])}" if parts.get("password") else "") + "@"
    hosts = ",".join(q(h["host"]) + (f":{h['port']}" if h.get("port") else "") for h in parts["hosts"])
    end = f"/{q(parts['endpoint'])}" if parts.get("endpoint") else ""
    options = "?" + "&".join(f"{q(k)}={q(v)}" for k, v in parts["options"].items()) if parts.get("options") else ""
    return f"{scheme}://{user}{hosts}{end}{options}"


def read(spark: SparkSession, engine: str, uri: str, sql: str) -> DataFrame:
    """A query on another database by its JDBC driver, which has to be on the class path."""
    p = parse(uri, uri.partition("://")[0].strip())
    host = ",".join(f"{h['host']}:{h['port']}" if "port" in h else h["host"] for h in p["hosts"])
    database = f";databaseName={p['endpoint']}" if engine == "sql-server" else f"/{p['endpoint'] or ''}"
    reader = spark.read.format("jdbc").option("url", f"jdbc:{_DRIVERS[engine]}://{host}{database}").option("query", sql)
    for k in ("username", "password"):
        if p[k]:
            reader = reader.option("user" if k == "username" else k, p[k])
    return reader.load()
