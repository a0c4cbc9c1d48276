"""The built-in rules and other fixed word lists."""

from credsieve.config import RegexRule

# ---------------------------------------------------------------------------
# Fixed values. Rule ids, names, severities and patterns have to be what they are for results
# to agree. The fourth part says where to look before running the pattern:
#   long    the match holds an unbroken run of at least 16 characters (see functions.runs)
#   anchor  texts, one of which is in every line the rule matches
#   folded  the same for a lower-cased line, for rules that ignore case; no text contains
#           'i' or 's', which have extra case variants outside ASCII
# ---------------------------------------------------------------------------
BUILTIN_RULES = [
    RegexRule("aws-access-key-id", "AWS Access Key ID", r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", "critical", "Identifier half of an AWS key pair", long=True, anchor=("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA")),
    RegexRule("aws-secret-access-key", "AWS Secret Access Key", r"""(?i)aws[_\-\s]?secret[_\-\s]?(?:access[_\-\s]?)?key[\s]*[=:"\s]+([A-Za-z0-9/+]{40})""", "critical", "Secret half of an AWS key pair, named as such", long=True, folded=("ecret",)),
    RegexRule("github-pat-classic", "GitHub Personal Access Token (Classic)", r"ghp_[A-Za-z0-9]{36}", "critical", "Classic personal token for GitHub", long=True),
    RegexRule("github-pat-fine-grained", "GitHub Fine-Grained PAT", r"github_pat_[A-Za-z0-9_]{82}", "critical", "Fine-grained personal token for GitHub", long=True),
    RegexRule("github-oauth-token", "GitHub OAuth Token", r"gho_[A-Za-z0-9]{36}", "critical", "Token an OAuth app holds for a GitHub user", long=True),
    RegexRule("github-actions-token", "GitHub Actions Token", r"ghs_[A-Za-z0-9]{36}", "critical", "Short-lived token of a GitHub workflow run", long=True),
    RegexRule("github-refresh-token", "GitHub Refresh Token", r"ghr_[A-Za-z0-9]{36}", "high", "Token that renews a GitHub OAuth session", long=True),
    RegexRule("stripe-secret-key", "Stripe Secret Key", r"sk_(?:live|test)_[A-Za-z0-9]{24,}", "critical", "Secret key for Stripe, live or test", long=True),
    RegexRule("stripe-publishable-key", "Stripe Publishable Key", r"pk_(?:live|test)_[A-Za-z0-9]{24,}", "medium", "Public key for Stripe; less harmful to leak", long=True),
    RegexRule("stripe-restricted-key", "Stripe Restricted Key", r"rk_(?:live|test)_[A-Za-z0-9]{24,}", "critical", "Scoped key for Stripe", long=True),
    RegexRule("google-api-key", "Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "high", "Key for Google APIs", long=True),
    RegexRule("google-oauth-client-secret", "Google OAuth Client Secret", r"GOCSPX-[A-Za-z0-9\-_]{28}", "high", "Client secret of a Google OAuth app", long=True),
    RegexRule("slack-bot-token", "Slack Bot Token", r"xoxb-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24}", "critical", "Token of a Slack bot user", long=True),
    RegexRule("slack-user-token", "Slack User Token", r"xoxp-[0-9]{10,13}-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{32}", "critical", "Token acting for a Slack user", long=True),
    RegexRule("slack-app-token", "Slack App-Level Token", r"xapp-[0-9]-[A-Z0-9]{10,13}-[0-9]{13}-[A-Za-z0-9]{64}", "high", "Token of a Slack app", long=True),
    RegexRule("slack-webhook", "Slack Incoming Webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "high", "Address that posts to a Slack channel", long=True),
    RegexRule("twilio-api-key", "Twilio API Key", r"SK[0-9a-fA-F]{32}", "high", "Key for Twilio", long=True),
    RegexRule("twilio-account-sid", "Twilio Account SID", r"AC[0-9a-fA-F]{32}", "medium", "Account identifier at Twilio", long=True),
    RegexRule("sendgrid-api-key", "SendGrid API Key", r"SG\.[A-Za-z0-9\-_]{22}\.[A-Za-z0-9\-_]{43}", "high", "Key for SendGrid", long=True),
    RegexRule("mailgun-api-key", "Mailgun API Key", r"key-[0-9a-zA-Z]{32}", "high", "Private key for Mailgun", long=True),
    RegexRule("npm-access-token", "npm Access Token", r"npm_[A-Za-z0-9]{36}", "high", "Token for the npm registry", long=True),
    RegexRule("pypi-upload-token", "PyPI Upload Token", r"pypi-[A-Za-z0-9\-_]{72,}", "high", "Token that uploads to PyPI", long=True),
    RegexRule("hashicorp-vault-token", "HashiCorp Vault Token", r"(?:hvs|hvb|hvr)\.[A-Za-z0-9]{24,}", "critical", "Service, batch or recovery token of Vault", long=True, anchor=("hvs.", "hvb.", "hvr.")),
    RegexRule("jwt-token", "JSON Web Token", r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "medium", "Signed web token; its claims are readable"),
    RegexRule("private-key-rsa", "RSA Private Key", r"-----BEGIN RSA PRIVATE KEY-----", "critical", "Head of an RSA key in PEM form", anchor=("PRIVATE KEY-----",)),
    RegexRule("private-key-ec", "EC Private Key", r"-----BEGIN EC PRIVATE KEY-----", "critical", "Head of an elliptic-curve key in PEM form", anchor=("PRIVATE KEY-----",)),
    RegexRule("private-key-openssh", "OpenSSH Private Key", r"-----BEGIN OPENSSH PRIVATE KEY-----", "critical", "Head of an OpenSSH key", anchor=("PRIVATE KEY-----",)),
    RegexRule("private-key-generic", "Generic Private Key", r"-----BEGIN PRIVATE KEY-----", "critical", "Head of a PEM key of unnamed type", anchor=("PRIVATE KEY-----",)),
    RegexRule("postgres-connection-string", "PostgreSQL Connection String", r"""postgres(?:ql)?://[^:]+:[^@]+@[^\s"'`]+""", "high", "PostgreSQL address with user and password", anchor=("://",)),
    RegexRule("mysql-connection-string", "MySQL Connection String", r"""mysql://[^:]+:[^@]+@[^\s"'`]+""", "high", "MySQL address with user and password", anchor=("://",)),
    RegexRule("mongodb-connection-string", "MongoDB Connection String", r"""mongodb(?:\+srv)?://[^:]+:[^@]+@[^\s"'`]+""", "high", "MongoDB address with user and password", anchor=("://",)),
    RegexRule("redis-connection-string", "Redis Connection String with Auth", r"""redis://:[^@]+@[^\s"'`]+""", "high", "Redis address with a password", anchor=("://",)),
    RegexRule("generic-secret-assignment", "Generic Secret Assignment", r"""(?i)(?:secret|passwd|password|api[_-]?key|auth[_-]?token|access[_-]?token|private[_-]?key)\s*[=:]\s*["\x27]([A-Za-z0-9\-_./+]{16,})["\x27]""", "medium", "Quoted value given to a name such as password or api_key", long=True, folded=("ecret", "wd", "word", "key", "token")),
    RegexRule("bearer-token", "Bearer Token in Header", r"""(?i)Authorization["\x27]?\s*:\s*["\x27]?Bearer\s+([A-Za-z0-9\-_./+]{20,})""", "medium", "Bearer token in an Authorization header", long=True, folded=("bearer",)),
    RegexRule("basic-auth-url", "Credentials in URL", r"""(?i)https?://[^:@\s]+:[^@\s]{6,}@[^\s"'`]+""", "high", "Web address with user and password", anchor=("://",)),
]

# Path globs no scan looks into.
IGNORED_GLOBS = [
    "**/node_modules/**",
    "**/vendor/**",
    "**/.venv/**",
    "**/venv/**",
    "**/.env/**",
    "**/site-packages/**",
    "**/dist/**",
    "**/build/**",
    "**/__pycache__/**",
    "**/.git/**",
    "**/coverage/**",
    "**/.nyc_output/**",
    "**/bower_components/**",
    "**/package-lock.json",
    "**/pnpm-lock.yaml",
    "**/go.sum",
    "**/Cargo.lock",
]

# File extensions that are not text, or are lock files.
SKIPPED_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".pdf", ".zip", ".tar",
    ".gz", ".bz2", ".xz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o",
    ".a", ".class", ".pyc", ".pyo", ".pyd", ".wasm", ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".lock",
]

# Fixed value: the largest file read, in bytes.
MAX_FILE_BYTES = 1024 * 1024
