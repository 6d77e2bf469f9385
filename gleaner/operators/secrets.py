"""Secret and sensitive-path scanning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of secrets, matched without regard to case.
PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"[a-zA-Z0-9_-]*api[_-]?key[a-zA-Z0-9_-]*\s*[:=]",
    r"[a-zA-Z0-9_-]*apikey[a-zA-Z0-9_-]*\s*[:=]",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"ghu_[a-zA-Z0-9]{36}",
    r"ghs_[a-zA-Z0-9]{36}",
    r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}",
    r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*",
    r"sk-[a-zA-Z0-9]{48}",
    r"sk-proj-[a-zA-Z0-9_-]{80,}",
    r"[a-zA-Z0-9_-]*password[a-zA-Z0-9_-]*\s*[:=]",
    r"[a-zA-Z0-9_-]*secret[a-zA-Z0-9_-]*\s*[:=]",
    r"[a-zA-Z0-9_-]*private[_-]?key[a-zA-Z0-9_-]*\s*[:=]",
    r"postgres://[^:]+:[^@]+@",
    r"mysql://[^:]+:[^@]+@",
    r"mongodb(\+srv)?://[^:]+:[^@]+@",
    r"redis://[^:]+:[^@]+@",
    r"AZURE[_-]?[A-Z_]*[_-]?(KEY|SECRET|TOKEN|PASSWORD)",
    r"[a-zA-Z0-9_-]*AWS[_-]?SECRET[a-zA-Z0-9_-]*",
    r"-----BEGIN (RSA |DSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    r"-----BEGIN CERTIFICATE-----",
    r"bearer\s+[a-zA-Z0-9_\-.]+",
    r"authorization:\s*(bearer|basic)\s+[a-zA-Z0-9_\-.]+",
)
#: Names and endings of files that commonly hold secrets.
NAMES = (
    ".env .env.local .env.development .env.production .env.staging .env.test id_rsa id_dsa id_ecdsa id_ed25519 .npmrc .pypirc .netrc .htpasswd credentials "
    "secrets.json secrets.yml secrets.yaml config.json config.yml"
).split()
SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".log")
MAX_BYTES = 2_000_000


def is_sensitive_path(path: Column) -> Column:
    """Whether the file name is a known one, begins with ``.env`` or has a known ending; a null path isn't sensitive."""
    base = F.element_at(F.split(path, "/"), -1)
    hit = base.isin(*NAMES) | base.startswith(".env")
    for s in SUFFIXES:
        hit = hit | base.endswith(s)
    return F.coalesce(hit, F.lit(False))


#: Endings and parts of staged paths that are warned of.
STAGED_SUFFIXES = (".env", ".pem", ".key", ".p12", ".pfx", ".log")
STAGED_PARTS = ("id_rsa", "id_ed25519", "credentials", ".npmrc", ".netrc")


def is_staged_sensitive(path: Column) -> Column:
    """Whether a staged path is warned of, case aside; a null path isn't."""
    p = F.lower(path)
    hit = F.lit(False)
    for s in STAGED_SUFFIXES:
        hit = hit | p.endswith(s)
    for s in STAGED_PARTS:
        hit = hit | F.contains(p, F.lit(s))
    return F.coalesce(hit, F.lit(False))


def has_secret(line: Column) -> Column:
    """Whether any pattern occurs; a null line has none. One alternation, so that each line is scanned once.

    What a pattern may begin with, but need not, does not change whether it occurs, and would be tried at every position.
    """
    lead = "[a-zA-Z0-9_-]*"
    return F.coalesce(line.rlike("(?i)(?:" + "|".join(p.removeprefix(lead) for p in PATTERNS) + ")"), F.lit(False))


def text_lines(files: DataFrame, path: str, text: str, *carry: str) -> DataFrame:
    """(path, carry..., line_no, line) of all texts; lines end with LF or CRLF, and a last empty line is none."""
    split = F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), r"\r?\n")
    # no filter: it would be pushed below, and a text that is an expression would be made twice
    some = F.when(F.col(text) != "", split)
    return files.select(F.col(path).alias("path"), *carry, F.posexplode(some).alias("p", "line")).select("path", *carry, (F.col("p") + 1).alias("line_no"), "line")


def scan(files: DataFrame, path: str, text: str, most: int | None = None) -> DataFrame:
    """(path, line_no, line) of lines with a secret, trimmed, each once. ``most`` keeps the first hits in file order only,
    which is a feature of reports. Texts over MAX_BYTES are passed over, as are null ones."""
    small = files.where(F.octet_length(text) <= MAX_BYTES)
    hits = text_lines(small, path, text).where(has_secret(F.col("line"))).select("path", "line_no", F.trim("line").alias("line")).distinct()
    if most is None:
        return hits
    return hits.orderBy("path", "line_no").limit(most)
