"""Azure Blob URLs, in the forms people write them, as Hadoop ``abfss`` paths."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from tidegauge.errors import SourceError

# URL forms and endpoints.
SCHEMES = ("az://", "abfs://", "abfss://")
BLOB_HOST = ".blob.core.windows.net"
DFS_HOST = ".dfs.core.windows.net"


def is_object_url(source: str) -> bool:
    """Whether the scheme, or the host of a web address, is that of an object store."""
    parts = urlsplit(source)
    return f"{parts.scheme}://" in SCHEMES or (parts.hostname or "").endswith(BLOB_HOST)


def account_of(url: str) -> str | None:
    """The storage account: the first label of the host name, if that is an endpoint's."""
    host = urlsplit(url).hostname or ""
    return host.partition(".")[0] or None if host.endswith((BLOB_HOST, DFS_HOST)) else None


def rewrite_url(url: str, account: str | None = None) -> str:
    """The ``abfss://container@account.dfs.core.windows.net/path`` form of ``url``."""
    low = url.lower()
    if low.startswith("abfss://") and "@" in url:
        return url
    if BLOB_HOST + "/" in low:
        account = account_of(url)
        rest = url[low.index(BLOB_HOST) + len(BLOB_HOST) + 1 :]
    else:
        rest = url.split("://", 1)[1]
        if "@" in rest:
            return f"abfss://{rest}"
    container, _, path = rest.partition("/")
    if not account:
        raise SourceError(f"{url}: give the storage account, or a URL that names it")
    return f"abfss://{container}@{account}{DFS_HOST}/{path}"


def connection_settings(
    account: str | None = None, connection_string: str = "", sas_token: str = ""
) -> dict[str, str]:
    """Hadoop settings for a connection string (first choice) or a SAS token."""
    if connection_string:
        pairs = dict(p.split("=", 1) for p in connection_string.split(";") if "=" in p)
        name, secret = pairs.get("AccountName", account), pairs.get("AccountKey")
        if not name or not secret:
            raise SourceError("the connection string needs AccountName and AccountKey")
        return {f"fs.azure.account.key.{name}{DFS_HOST}": secret}
    if sas_token:
        if not account:
            raise SourceError("a SAS token needs the storage account")
        host = f"{account}{DFS_HOST}"
        return {
            f"fs.azure.account.auth.type.{host}": "SAS",
            f"fs.azure.sas.fixed.token.{host}": sas_token.lstrip("?"),
        }
    return {}


def connect(spark: SparkSession, settings: dict[str, str]) -> None:
    """Put the settings where every scan of this session finds them."""
    for key, value in settings.items():
        spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
