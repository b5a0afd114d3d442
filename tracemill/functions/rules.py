"""Rule tables used by the models, kept as data."""

from __future__ import annotations

# Tool name, category, description.
TOOL_CATEGORIES = [
    ("Read", "file_operations", "Read file contents"),
    ("Write", "file_operations", "Write file contents"),
    ("Edit", "file_operations", "Edit file contents"),
    ("NotebookEdit", "file_operations", "Edit Jupyter notebook cells"),
    ("MultiEdit", "file_operations", "Multiple file edits in one operation"),
    ("Bash", "shell", "Execute shell commands"),
    ("Glob", "search", "Search files by glob pattern"),
    ("Grep", "search", "Search file contents with regex"),
    ("Task", "agent", "Spawn sub-agent for complex tasks"),
    ("TodoRead", "planning", "Read todo list"),
    ("TodoWrite", "planning", "Write/update todo list"),
    ("WebFetch", "network", "Fetch web page content"),
    ("WebSearch", "network", "Search the web"),
    ("AskFollowupQuestion", "interaction", "Ask user for clarification"),
    ("AttemptCompletion", "interaction", "Signal task completion"),
]

# Tools whose text is searched for a path, and the tool groups.
PATH_TOOLS = ["Read", "Write", "Edit", "Glob"]
FILE_TOOLS = ["Read", "Write", "Edit", "NotebookEdit", "MultiEdit"]
SEARCH_TOOLS = ["Glob", "Grep", "WebSearch"]
SHELL_TOOL = "Bash"

# LIKE patterns per task category; the first category that matches wins.
TASK_PATTERNS = {
    "bug_fix": ["%fix%", "%bug%", "%error%", "%issue%", "%broken%", "%not working%"],
    "feature": ["%add%feature%", "%implement%", "%create%", "%build%", "%new%function%"],
    "refactor": ["%refactor%", "%clean up%", "%improve%", "%optimize%", "%restructure%"],
    "testing": ["%test%", "%spec%", "%coverage%", "%assert%"],
    "documentation": ["%document%", "%readme%", "%comment%", "%explain%"],
    "review": ["%review%", "%look at%", "%check%", "%what does%"],
}

# The alternative rules, regular expressions on word boundaries.
TASK_WORD_PATTERNS = {
    "bug_fix": [r"\bbug\b", r"\bfix\b", r"\berror\b", r"\bissue\b", r"\bbroken\b", r"\bfailing\b", r"\bcrash\b"],
    "feature": [r"\badd\b", r"\bcreate\b", r"\bimplement\b", r"\bnew\b", r"\bfeature\b", r"\bbuild\b"],
    "refactor": [r"\brefactor\b", r"\brestructure\b", r"\breorganize\b", r"\bclean\s*up\b", r"\bsimplify\b"],
    "testing": [r"\btest\b", r"\bspec\b", r"\bvalidat\b", r"\bverif\b"],
    "documentation": [r"\bdoc\b", r"\breadme\b", r"\bcomment\b", r"\bexplain\b"],
}

# File extensions per file type.
FILE_TYPES = {
    "javascript": ["ts", "tsx", "js", "jsx"],
    "python": ["py", "pyw"],
    "jvm": ["java", "kt", "scala"],
    "go": ["go"],
    "rust": ["rs"],
    "sql": ["sql"],
    "documentation": ["md", "mdx", "txt", "rst"],
    "config": ["json", "yaml", "yml", "toml", "xml"],
    "styles": ["css", "scss", "less"],
    "html": ["html", "htm"],
    "shell": ["sh", "bash", "zsh"],
    "docker": ["dockerfile", "docker-compose"],
}

# Regular expressions for a path and for an extension (group 1).
PATH_REGEX = r"([/][a-zA-Z0-9_./-]+)"
EXTENSION_REGEX = r"\.([a-zA-Z0-9]+)(?:[^a-zA-Z0-9]|$)"
PROJECT_REGEX = r"projects/([^/]+)"

# Day names, Sunday first.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Upper bounds (inclusive or exclusive as named) of the classes.
DURATION_CLASSES = [("quick", 60), ("short", 600), ("medium", 3600)]  # below, else long
ACTIVITY_LEVELS = [("minimal", 5), ("light", 20), ("moderate", 50)]  # up to, else heavy
PROJECT_STATUS = [("active_today", 1), ("active_this_week", 7), ("active_this_month", 30)]  # up to, else inactive
PROJECT_SIZES = [("small", 5), ("medium", 20)]  # up to, else large; exactly one session is its own class
USAGE_TIERS = [("unused", 0), ("rare", 10), ("occasional", 100), ("frequent", 1000)]  # up to, else heavy
