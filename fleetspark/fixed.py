"""Fixed values.

Every value here must equal what the fleets, their runners, workflows,
provider inventories and configuration files already use (label names and
prefixes, the telemetry marker, message formats, name patterns, limits).
Matching and reports depend on them verbatim, so they are stated once, as
plain text, and imported by the operators.  Names that a deployment chooses
itself are not fixed: they come in as a :class:`Project`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- cycle telemetry contract -------------------------------------------
TELEMETRY_PREFIX = "cycle_telemetry "
TELEMETRY_EVENT = "runner_cycle_complete"
TELEMETRY_SCHEMA_VERSION = 1

# --- runner and sandbox labels ------------------------------------------
RUNNER_ROLE = "gha-runner"
SCOPE_ORGANIZATION = "organization"
SCOPE_REPOSITORY = "repository"
SCOPES = ("organization", "repository")
PROVIDER_LABEL = "daytona"
ORG_RUNNER_GROUP = "daytona"

# --- workflow scans -------------------------------------------------------
RUNS_ON_TARGET = "[self-hosted, daytona]"
RUNS_ON_LINE = r"^(\s*)runs-on:\s*(.+?)\s*$"
SKIP_PLATFORMS = ("windows", "macos", "macOS")
USES_LINE = r"^\s*uses:\s*[^#\s]+"
PINNED_REF = r"@[0-9a-fA-F]{40}$"
FORBIDDEN_NAMES = ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN",
                   "aws-access-key-id", "aws-secret-access-key", "aws-session-token")

# --- configuration rules --------------------------------------------------
FLEET_NAME = r"^[a-z0-9][a-z0-9-]*$"
OWNER_NAME = r"^[A-Za-z0-9][A-Za-z0-9-]*$"
RUNNER_GROUP_NAME = r"^[a-z0-9][a-z0-9-]*$"
REPOSITORY_NAME = r"^(?:\.github|[A-Za-z0-9][A-Za-z0-9._-]*)$"
PROVIDER_TARGET = r"^[a-z0-9][a-z0-9-]{0,62}$"
DOMAIN_NAME = r"^(?:\*\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
FORBIDDEN_CONFIG_KEYS = r"(?i)(?:api[_-]?key|token|secret|password|private)"
ENV_NAME = r"^[A-Z][A-Z0-9_]{0,63}$"
NETWORK_POLICY = "deny-by-default"
REQUIRED_CLASSES = ("default", "large")
LIFECYCLE_SECS = ("hold_on_failure_secs", "idle_poll_secs", "fast_idle_poll_secs", "fast_idle_window_secs", "busy_poll_secs",
                  "job_max_secs", "idle_refresh_secs", "demand_idle_secs", "auto_stop_minutes")
LIFECYCLE_POLLS = ("idle_poll_secs", "fast_idle_poll_secs", "busy_poll_secs")
# Tables with a closed list of keys; other tables take any.  The github table's list depends on the scope.
CLOSED_KEYS = {
    "network": ("policy", "cidr_allow_list", "domain_allow_list"),
    "routing": ("required_labels",),
    "poller": ("interval_secs", "request_spacing_secs"),
    "webhook": ("listen", "hmac_env"),
    "lifecycle": ("ephemeral", "auto_delete_interval", *LIFECYCLE_SECS),
    "watchdog": ("github_queue_scan",),
}
GITHUB_KEYS = {
    "organization": ("scope", "org", "runner_group"),
    "repository": ("scope", "owner", "runner_group_id", "runner_group", "repositories"),
}
# The owner's key per scope, and the keys that every manifest entry may have beside it.
OWNER_KEYS = {
    "profile": {"organization": "org", "repository": "owner"},
    "manifest": {"organization": "organization", "repository": "owner"},
}
MANIFEST_KEYS = ("name", "scope", "profile", "installation_id_key")
LISTEN_HOSTS = ("127.0.0.1", "0.0.0.0", "::1", "localhost")
PROVIDER_API_BASE = "https://app.daytona.io/api"
# IPv4 ranges Python's ipaddress treats as private (IANA special-purpose
# registry), as (first address, prefix length).
PRIVATE_V4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
              ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
              ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32))

# --- webhook --------------------------------------------------------------
MAX_BODY_BYTES = 1024 * 1024
WEBHOOK_PATHS = ("/github", "/webhook", "/")
SIGNATURE_PREFIX = "sha256="

# --- limits and timings -----------------------------------------------------
BACKOFF_INITIAL_SECS = 60
BACKOFF_MAX_SECS = 900
RATE_LIMITED = (403, 429)
ORPHAN_SWEEP_GRACE_SECS = 180
SESSION_READ_MAX_ERRS = 3
MESSAGE_TOP = 10
ID_TOP = 5
ID_CHARS = 8
MESSAGE_CHARS = 3500
MAX_TOTAL_PAGES = 1000  # default of the page check's parameter
MAX_LIVE_DEFAULT = 10**9

# --- snapshot retirement policy -------------------------------------------
FAILED_BUILD_DAYS = 7
REPLACED_DAYS = 14
DEFAULT_DAYS = 30
MIN_REPLACEMENT_SUCCESSES = 100


# --- names a deployment chooses ---------------------------------------------
@dataclass(frozen=True)
class Project:
    """Project label and app name of a deployment; the other names follow from them."""

    label: str
    app_name: str

    @property
    def fleet_label_prefix(self) -> str:
        return f"{self.label}-fleet-"

    @property
    def runner_name_prefix(self) -> str:
        return f"{self.label}-"

    @property
    def shared_labels(self) -> tuple[str, ...]:
        """Labels that every fleet shares, so no routing label may equal one."""
        return ("self-hosted", PROVIDER_LABEL, self.label, "large")

    @property
    def rewrite_scalar(self) -> str:
        """Scalar ``runs-on`` values that are retargeted."""
        return rf"^({re.escape(self.label)}|{PROVIDER_LABEL}|blacksmith[\w.-]*|ubuntu-[\w.-]+|ubuntu-latest)$"

    @property
    def rewrite_array_labels(self) -> tuple[str, ...]:
        return ("self-hosted", self.label)


#: Neutral names for fixtures, tests and defaults.
PROJECT = Project("cipool", "Fleet App")
