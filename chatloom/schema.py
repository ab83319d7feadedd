"""Tables, labels and enumerations of the conversation model."""

from __future__ import annotations

#: Providers in canonical order, their display labels and configuration slugs.
PROVIDERS = {
    "claude_code": ("Claude Code", "claude-code"),
    "gemini_cli": ("Gemini CLI", "gemini-cli"),
    "copilot_cli": ("Copilot CLI", "copilot-cli"),
    "codex_cli": ("Codex CLI", "codex-cli"),
    "opencode": ("OpenCode", "opencode"),
}
#: Order in which a session id is looked up.
LOOKUP_ORDER = ("claude_code", "gemini_cli", "copilot_cli", "codex_cli", "opencode")
#: Display labels of roles.
ROLES = {"user": "You", "assistant": "Assistant", "system": "System", "tool": "Tool"}

BLOCK = "struct<type:string,text:string,language:string,tool_call_id:string,tool_name:string,success:boolean>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint>"
SESSIONS = (
    "provider string, session_id string, project_path string, project_name string, git_branch string, started_at timestamp, "
    f"ended_at timestamp, summary string, model string, token_usage {USAGE}, message_count bigint, source_path string"
)
MESSAGES = f"provider string, session_id string, seq bigint, message_id string, role string, timestamp timestamp, content array<{BLOCK}>, model string, token_usage {USAGE}, source_path string"
MANIFEST = "provider string, session_id string, source_path string, fingerprint string"
