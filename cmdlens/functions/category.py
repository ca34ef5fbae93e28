"""Program -> category lookup and the tool-call tables.

The lookup is a literal map expression evaluated inside whole-stage codegen:
no join, nothing that grows with the data.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import program_name

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Program names per category, in the reference's order.
# ---------------------------------------------------------------------------
CATEGORY_PROGRAMS = {
    "vcs": ["git", "gh", "svn", "hg"],
    "containers": ["docker", "kubectl", "k9s", "helm", "podman", "kind", "minikube",
                   "docker-compose", "compose"],
    "build": ["make", "cargo", "go", "npm", "yarn", "pnpm", "gradle", "mvn", "maven",
              "pip", "pip3", "python", "python3", "node", "mix", "bundle", "rake",
              "cmake", "ninja", "meson"],
    "cloud": ["aws", "gcloud", "az", "terraform", "tf", "pulumi", "fly", "flyctl",
              "heroku", "ansible", "vault", "consul"],
    "system": ["sudo", "systemctl", "service", "kill", "killall", "pkill", "ps", "df", "du",
               "free", "uname", "uptime", "mount", "umount", "chmod", "chown", "useradd",
               "usermod"],
    "network": ["ssh", "scp", "rsync", "curl", "wget", "ping", "nmap", "netstat", "nc",
                "telnet", "traceroute", "dig", "nslookup", "ftp", "sftp"],
    "editor": ["vim", "nvim", "vi", "nano", "emacs", "code", "subl", "atom", "hx"],
    "shell": ["ls", "cd", "pwd", "echo", "cat", "grep", "awk", "sed", "find", "xargs",
              "sort", "uniq", "wc", "head", "tail", "less", "more", "cp", "mv", "rm",
              "mkdir", "touch", "ln", "export", "source", "alias", "history", "clear",
              "exit"],
}
DEFAULT_CATEGORY = "other"

# Tool-call hook tables (fixed values).
SKIPPED_TOOLS = [
    "TodoWrite", "TodoRead",
    "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskOutput", "TaskStop",
    "EnterPlanMode", "ExitPlanMode",
    "EnterWorktree", "ExitWorktree",
    "ToolSearch", "RemoteTrigger",
]
TOOL_ARG_KEY = {
    "Bash": "command",
    "Read": "file_path", "Write": "file_path", "Edit": "file_path",
    "MultiEdit": "file_path", "NotebookEdit": "notebook_path",
    "Glob": "pattern", "Grep": "pattern",
    "WebFetch": "url", "WebSearch": "query",
    "Agent": "description", "Skill": "skill",
    "CronCreate": "schedule", "CronDelete": "trigger_id",
}
TOOL_CATEGORY = {
    "Bash": "shell",
    "Read": "file", "Write": "file", "Edit": "file",
    "MultiEdit": "file", "NotebookEdit": "file",
    "Glob": "search", "Grep": "search",
    "WebFetch": "web", "WebSearch": "web",
    "Agent": "agent", "Skill": "agent",
    "CronCreate": "cron", "CronDelete": "cron", "CronList": "cron",
}
DEFAULT_TOOL_CATEGORY = "other"
# ---------------------------------------------------------------------------

PROGRAM_CATEGORY = {p: cat for cat, progs in CATEGORY_PROGRAMS.items() for p in progs}


def literal_map(d: dict[str, str]) -> Column:
    """A map<string,string> literal column."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def category_of_program(prog: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(PROGRAM_CATEGORY), prog), F.lit(DEFAULT_CATEGORY))


def category(cmd: Column | str) -> Column:
    """Category label of a command via its program name; ``other`` if unknown."""
    return category_of_program(program_name(cmd))
