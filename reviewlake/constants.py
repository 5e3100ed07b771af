"""Fixed values.

Every string below must equal the original tool's text for results to
match: labels, placeholders, default settings, wire formats. They are kept
together, in natural order, as plain text.
"""

# ---------------------------------------------------------------- fixed values
# Default settings written on install (canonical defaults).
INSTALL_DEFAULTS = {
    "aiService": "openai",
    "openai": {
        "apiKey": "",
        "apiEndpoint": "https://api.openai.com/v1/chat/completions",
        "model": "gpt-4o",
    },
    "anthropic": {
        "apiKey": "",
        "model": "claude-3-5-sonnet-latest",
    },
    "review": {
        "reviewPrompt": (
            "请用中文回复。作为代码审查员，请帮我检查以下代码：\n"
            "1. 代码质量和最佳实践\n"
            "2. 潜在的bug和安全问题\n"
            "3. 性能优化建议\n"
            "4. 可维护性和可读性改进\n"
            "\n"
            "代码信息：\n"
            "- 文件：{files}\n"
            "- 变更：{diff}\n"
            "- 语言：{language}\n"
            "- 历史review信息: {reviews}\n"
            "\n"
            "请根据上述信息和历史评论记录进行全面的代码审查，重点关注：\n"
            "1. 之前评论中提到的问题是否已经解决\n"
            "2. 是否有新的问题需要关注\n"
            "3. 代码改进的建议"
        ),
        "maxTokens": 1000,
        "ignoreFiles": [],
    },
}

# Defaults used by the settings form (load fallback, save fallback, reset).
FORM_DEFAULTS = {
    "aiService": "openai",
    "openai": {
        "apiKey": "",
        "apiEndpoint": "https://api.openai.com/v1/chat/completions",
        "model": "gpt-4",
    },
    "anthropic": {
        "apiKey": "",
        "model": "claude-3-sonnet-20240229",
    },
    "reviewPrompt": (
        "请用中文回复。作为代码审查员，请帮我检查以下代码：\n"
        "1. 代码质量和最佳实践\n"
        "2. 潜在的bug和安全问题\n"
        "3. 性能优化建议\n"
        "4. 可维护性和可读性改进\n"
        "\n"
        "代码信息：\n"
        "- 文件：{files}\n"
        "- 变更：{diff}\n"
        "- 语言：{language}\n"
        "- 已有评论：{reviews}"
    ),
    "maxTokens": 1000,
    "ignoreFiles": [],
}

# Template placeholders, in substitution order.
PLACEHOLDERS = ["{files}", "{diff}", "{language}", "{reviews}"]

# Timeline text.
NO_FEEDBACK_TEXT = "暂无评论和审查记录"
HISTORY_HEADER = "\n\n=== 历史评论记录 ===\n"
STATE_LABELS = {
    "APPROVED": "批准了PR",
    "CHANGES_REQUESTED": "请求修改",
    "COMMENTED": "评论了PR",
    "DISMISSED": "驳回了review",
}
LINE_COMMENT_IN_FILE = " 在文件 "
LINE_COMMENT_LINE = " 第 "
LINE_COMMENT_SUFFIX = " 行评论:\n"
FILE_COMMENT_SUFFIX = " 评论:\n"
ISSUE_COMMENT_SUFFIX = " 评论:\n"
CONTENT_SEPARATOR = ":\n"
FEEDBACK_JOINER = "\n\n"
FEEDBACK_KINDS = ["review_decision", "review_comment", "issue_comment"]

# Prompt pieces.
FILES_JOINER = "\n"
DIFFS_JOINER = "\n\n"
DIFF_HEADER_OPEN = "=== "
DIFF_HEADER_CLOSE = " ===\n"
LANGUAGES_JOINER = ", "

# Language-model requests.
SYSTEM_PROMPT = "你是一个专业的代码审查员，请用中文回复。"
OPENAI_TEMPERATURE = 0.7
ANTHROPIC_ENDPOINT = "https://api.anthropic.com/v1/messages"
OPENAI_HEADER_NAMES = ["Content-Type", "Authorization"]
ANTHROPIC_HEADER_NAMES = ["Content-Type", "x-api-key", "anthropic-version",
                          "anthropic-dangerous-direct-browser-access"]

# Stream wire format.
SSE_DATA_PREFIX = "data: "
SSE_DONE_LINE = "data: [DONE]"
ANTHROPIC_DELTA_TYPE = "content_block_delta"
CHARS_PER_TOKEN = 4

# Code-hosting API paths and the submitted review event.
FORGE_HOST = "github.com"
SUBMIT_EVENT = "COMMENT"

# Options page bounds for the output token cap.
MAX_TOKENS_MIN = 100
MAX_TOKENS_MAX = 4000

# Popup text.
LOADING_TEXT = "加载中..."
NOT_AVAILABLE_TEXT = "N/A"
PREVIEW_SUFFIX = "..."

# Error messages of the original, under codes of our own.
ERRORS = {
    "NO_FORGE_TOKEN": "GitHub Token未配置",
    "NO_OPENAI_KEY": "OpenAI API Key未置",
    "NO_ANTHROPIC_KEY": "Anthropic API Key未配置",
    "NO_FILES": "没有需要审查的文件",
    "UNSUPPORTED_SERVICE": "Unsupported AI service provider",
}

# JavaScript String.prototype.trim whitespace set.
JS_WHITESPACE = ("\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
                 "\u2028\u2029\u202F\u205F\u3000\uFEFF")

# Rendering of a review as HTML: pattern and replacement, in order of use.
HTML_RULES = [("\n", "<br>"), ("```([^`]+)```", "<pre><code>$1</code></pre>"), ("`([^`]+)`", "<code>$1</code>")]

# Popup labels of the PR summary and of the review statistics.
SUMMARY_REPO = "仓库: "
SUMMARY_NUMBER = "\nPR编号: #"
SUMMARY_TITLE = "\n标题: "
SUMMARY_FILES = "\n变更文件: "
SUMMARY_FILES_UNIT = "个"
STATS_REVIEWED = "审查文件数: "
STATS_ADDITIONS = "\n代码增加: +"
STATS_DELETIONS = "\n代码删除: -"
STATS_TOKENS = "\nToken消耗: "
# ------------------------------------------------------------ end fixed values

# Our own keys, defaults and messages (not part of the original).
OWN_ERRORS = {
    "MODEL_CALL_FAILED": "the model call failed",
    "NO_RESPONSE": "no response has arrived",
}
DEFAULT_KEYS = ("owner", "repo", "pr_number")
GHOST_AUTHOR = "ghost"
