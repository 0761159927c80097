"""Secrets and private paths in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key formats and how reasons name them.
NAMED_KEYS = (
    (r"sk-[a-zA-Z0-9]{20,}", "OpenAI"), (r"ghp_[a-zA-Z0-9]{36,}", "GitHub PAT"), (r"AKIA[A-Z0-9]{16}", "AWS Access Key"),
    (r"xox[bp]-[a-zA-Z0-9-]{10,}", "Slack token"), (r"glpat-[a-zA-Z0-9_-]{20,}", "GitLab PAT"), (r"npm_[a-zA-Z0-9]{36,}", "npm token"),
)
# Other secrets, and home folders.
GENERIC_SECRET = r"(?i)(?:key|token|password|secret|credential|auth)\s*[=:]\s*[\"']?[a-zA-Z0-9+/=_-]{20,}"
HOME_PATH = r"(?:C:\\\\Users\\[^\\]+|C:\\Users\\[^\\]+|/home/[^/]+|/Users/[^/]+)"


def reasons(text: Column) -> Column:
    """One masked reason for each secret found: named keys in the order of their list, then others."""
    def masked(pattern: str, name: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit("API key detected: "), F.substring(m, 1, 4), F.lit(f"*** ({name} pattern)")))

    named = [masked(p, name) for p, name in NAMED_KEYS]
    generic = F.transform(F.regexp_extract_all(text, F.lit(GENERIC_SECRET), F.lit(0)), lambda m: F.concat(F.lit('Generic secret detected near keyword "'), F.regexp_extract(m, r"^([^\s=:]*)", 1), F.lit('"')))
    return F.concat(*named, generic)


def anonymized(text: Column) -> Column:
    """Home folders as ~."""
    return F.regexp_replace(text, HOME_PATH, "~")
