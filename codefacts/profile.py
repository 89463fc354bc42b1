"""Per-repository-shape settings (the ``Profile``) and the fixed word lists they default to."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
# These lists decide which files count and how; results depend on their exact content.

EXCLUDED_DIRS = (
    ".git", ".github", ".pytest_cache", ".cache", ".mypy_cache", ".idea", ".vscode", ".pio",
    "venv", ".venv", "env", "node_modules", "libdeps", "__pycache__",
    "data", "backups", "server_backup", "tmp", "temp", "poc", "poc2",
    "dist", "dist-electron", "dist-new", "build", "release", "release-staging", "docs",
)

ROOT_SCRIPT_PREFIXES = (
    "run_final_test", "run_full_test", "run_comprehensive_test",
    "debug_", "verify_", "check_", "inspect_", "find_", "fetch_",
    "get_", "test_", "deploy_patch", "do_",
)

ROOT_TEMP_EXTS = (".json", ".sig", ".log", ".bak", ".tmp")

ROOT_ENTRY_SCRIPTS = ("auth_server.py", "health_guardian.py", "run_gunicorn.py", "run_auth_wsgi.py", "version.py")

CODE_EXTS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".vue", ".html", ".htm", ".css", ".scss", ".sh", ".sql",
    ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".ino", ".pde",
)

PY_EXTS = (".py",)

CXX_EXTS = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".inl", ".ino", ".pde")

TEXT_ASSET_EXTS = (".md", ".txt", ".yml", ".yaml", ".json", ".toml", ".ini", ".cfg")

BINARY_EXTS = (
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".zip", ".gz", ".tar", ".7z", ".rar", ".pdf",
    ".db", ".sqlite", ".sqlite3", ".lock", ".sig",
    ".mp3", ".mp4", ".wav", ".webm",
)

LINE_COMMENT_PREFIXES = ("#", "//")

#: extension -> language label of the file mirror table
LANGUAGE_LABELS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".vue": "vue", ".md": "markdown",
    ".json": "json", ".sh": "shell", ".bat": "batch", ".yml": "yaml", ".yaml": "yaml",
    ".html": "html", ".css": "css", ".sql": "sql",
}

MANIFEST_REQUIRED = (
    "identifier", "name", "version", "description", "author", "min_app_version", "agent_role", "capabilities",
)

HIGH_CHURN = 5
HIGH_LOC = 800
CHURN_DAYS = 90
MAX_FILE_LINES = 2000
MAX_FUNCTION_LINES = 120

APP_LIKE_OWNERS = ("app", "router", "api", "server")
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")

SEMVER_PATTERN = r"^\d+\.\d+\.\d+$"
IDENTIFIER_PATTERN = r"^[a-z0-9_]+$"
# ----------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class Profile:
    """What a repository looks like: where components live, what is excluded, which gates apply."""

    name: str = "default"
    signature_dirs: tuple[str, ...] = ("plugins", "plugin_manager")
    signature_files: tuple[str, ...] = ()
    component_dir: str = "plugins"
    manifest_name: str = "plugin.json"
    manifest_schema_path: str = "docs/plugin-manifest.schema.json"
    manifest_required: tuple[str, ...] = MANIFEST_REQUIRED
    core_dir: str = "plugin_manager"
    core_modules: dict[str, str] = field(default_factory=dict)
    core_dir_names: tuple[str, ...] = ("plugin_manager", "shared", "i18n")
    auto_core_exclude: tuple[str, ...] = ()
    base_class: str = "BasePlugin"
    manager_class_pattern: str = "Manager"
    framework_files: dict[str, str] = field(
        default_factory=lambda: {
            "base": "base.py", "manager": "manager.py", "discovery": "discovery.py",
            "hooks": "hooks.py", "events": "event_bus.py",
        }
    )
    excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS
    root_entry_scripts: tuple[str, ...] = ROOT_ENTRY_SCRIPTS
    group_names: tuple[str, ...] = ()
    key_docs: tuple[str, ...] = ("README.md", "CHANGELOG.md", "AGENTS.md")
    standard_doc_pattern: str = r"^docs/plugin-standard-v[^/]*\.md$"
    agent_role_glob: str = ""
    agent_role_strip: str = ""
    gates: tuple[str, ...] = (
        "manifest-invalid", "boundary-violation", "plugin-cycle", "include-cycle",
        "route-unprefixed", "file-too-large", "findings",
    )
    route_prefix_pattern: str | None = "/admin/{identifier}"
    default_component_prefix: str = ""
    frontend_names: tuple[str, ...] = ()
    max_file_lines: int = MAX_FILE_LINES
    max_function_lines: int = MAX_FUNCTION_LINES


#: A profile for repositories without components.
GENERIC = Profile(
    name="generic-python", signature_dirs=(), signature_files=("pyproject.toml",), component_dir="",
    manifest_name="", core_dir="", core_dir_names=(), gates=("file-too-large",), route_prefix_pattern=None,
    standard_doc_pattern="", auto_core_exclude=("docs", "tests", "scripts", "tools", "build", "dist"),
)

EMBEDDED = Profile(
    name="embedded", signature_dirs=(), signature_files=("platformio.ini",), component_dir="", manifest_name="",
    core_dir="", core_dir_names=(), gates=("file-too-large", "include-cycle"), route_prefix_pattern=None,
    standard_doc_pattern="",
)
