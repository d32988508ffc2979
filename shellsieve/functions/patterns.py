"""Rule texts. Each block holds fixed values in the order they are tried."""

from __future__ import annotations

# --- fixed values: rule categories of a command ------------------------------
DEFINITE_PAYLOAD = (
    r"attacker\.com|/dev/tcp|/dev/udp|nc\s+-e|busybox\s+nc|exec\s+bash\s+-i|>&\s*/dev/tcp"
    r"|curl\s+.*attacker|wget\s+.*attacker"
)
FETCH = r"curl|wget"
RUN = r"\|\s*(sh|bash)|;\s*(sh|bash)|-o\s+/tmp|--output"
SHELL_ESCAPE = (
    r"system\(|exec\s+/bin/sh|/bin/sh\s*</dev|/bin/sh\s*1>&|!sh\b|!/bin/sh|-e\s*['\"]system|rsh-command"
)

# --- fixed values: evidence that keeps a label -------------------------------
WEB_DEPLOY = (
    r"(/var/www|/usr/share/nginx|/html/|/uploads/|/wp-content/|\.php\b|\.jsp\b|\.aspx\b|\.phtml\b"
    r"|nginx/html|www/html|webshell-detection-lab)"
)
WEB_WRITE = (
    r"(>\s*\S+\.(php|jsp|aspx|phtml)\b|tee\s+\S+\.(php|jsp|aspx)|<\?php"
    r"|system\(\$_(GET|POST|REQUEST|COOKIE))"
)
KEY_CAPTURE = r"(keylog|evtest|/dev/input|logkeys|xinput|script\s+-q|strace|keystroke|kbd)"

# --- fixed values: gates for generated candidates ----------------------------
WEB_REJECT = r"(fsockopen|/dev/tcp/|nc\s+-e|ncat\s+-e|bash\s+-i|0>&1|proc_open\(|socket\.socket)"
WEB_ACCEPT = r"(\.php\b|\.jsp\b|\.aspx\b|/html/|/www/|/uploads/)"
SPREAD_ACCEPT = r"(ssh |scp |rsync |xargs .*ssh|for h in|while read)"

# --- fixed values: prose lines and prompts around fenced commands ------------
PROSE_LINE = r"^(victim|listener|target|attacker|windows|linux|macos|server|client)\s*[:\-]"
PROMPT_PREFIX = r"^[\w@.-]+[\$#>]\s*"
