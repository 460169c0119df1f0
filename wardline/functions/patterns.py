"""Text patterns and word lists.

Every value here is fixed: changing one changes results. `hints` are literals
implied by a pattern: text without one of each group cannot match, which spares
the regular expression. They are tested against case-folded text.
"""

from __future__ import annotations

from dataclasses import dataclass

# What counts as a blank, including the four ASCII separators.
BLANK = r"[\s\x1c-\x1f]"
NOT_BLANK = r"[^\s\x1c-\x1f]"

# Fixed value: characters on which the built-in word edge differs from the one below. Text
# without them, nearly all of it, takes the built-in one, which is several times faster.
ODD_EDGES = (r"[\p{M}\p{No}\x{200c}\x{200d}[\p{Pc}&&[^_]][\p{So}&&\p{IsAlphabetic}]]")

# Fixed value: edge of a word of letters, numbers and underscores; marks are no part of it.
WORD_EDGE = (r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))")


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    ignore_case: bool = False
    hints: tuple[tuple[str, ...], ...] = ()
    detect_regex: str | None = None

    def flagged(self, regex: str | None = None, exact_edges: bool = False) -> str:
        """The expression with Unicode classes and line rules as the results need them."""
        body = (regex or self.regex).replace(r"\s", BLANK).replace(r"\S", NOT_BLANK)
        if exact_edges:
            body = body.replace(r"\b", WORD_EDGE)
        return ("(?iUd)" if self.ignore_case else "(?Ud)") + body

    def detector(self, exact_edges: bool = False) -> str:
        """Expression for finding, which may be narrower than the one for replacing."""
        return self.flagged(self.detect_regex, exact_edges)

    @property
    def has_edges(self) -> bool:
        return r"\b" in self.regex


# Personal data patterns, in the order in which they are applied.
# A vehicle number only counts when it mixes letters and digits, but any run of
# that shape is replaced.
PII_PATTERNS = (
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", hints=(("@",),)),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b"),
    Pattern("salary", r"\b(salary|gehalt|salaire|salario)\b", True,
            hints=(("salar", "gehalt", "salair"),)),
    Pattern("birth_date", r"\b(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\b",
            hints=(("-0", "-1"),)),
    Pattern("phone",
            r"(?:\+\d{1,3}[\s\-]\d{2,5}[\s\-]\d{3,10}|\b\d{3}[\s\-]\d{3,4}[\s\-]\d{4}\b)"),
    Pattern("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b",
            detect_regex=r"\b(?=[A-Z]{0,16}[0-9])(?=[0-9]{0,16}[A-Z])[A-HJ-NPR-Z0-9]{17}\b"),
    Pattern("coordinates",
            r"\b-?(?:90(?:\.0{4,})?|[1-8]?\d\.\d{4,})\s*[,;]\s*"
            r"-?(?:180(?:\.0{4,})?|(?:1[0-7]\d|\d{1,2})\.\d{4,})\b",
            hints=((",", ";"),)),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", hints=(("-",),)),
)

# Personal data that makes a text restricted; the rest makes it confidential.
RESTRICTED_PII = ("salary", "birth_date", "ssn")

# Personal data patterns that need a digit.
DIGIT_PII = ("iban", "birth_date", "phone", "vin", "coordinates", "ssn")

# Substrings of lower-cased text.
CONFIDENTIAL_KEYWORDS = (
    "cost", "budget", "revenue", "profit", "loss", "cost_center", "fiscal",
    "defect_rate", "quality_metric", "supplier_contract", "bid", "tender",
    "internal only", "vertraulich", "confidentiel",
)
RESTRICTED_KEYWORDS = (
    "salary", "gehalt", "personnel", "hr record", "employee_id", "birth_date",
    "medical", "health", "performance_review", "termination", "legal",
)

# Fixed value: a currency amount.
CURRENCY = Pattern("currency", r"\b\d{4,}\s*(EUR|USD|GBP|€|\$|£)\b", True,
                   hints=(("eur", "usd", "gbp", "€", "$", "£"),))

# Brands looked for in text.
KNOWN_BRANDS = ("brand_a", "brand_b", "brand_c", "brand_d", "brand_e", "corp_brand")

# Placeholders and sizes.
ABOVE_CLEARANCE = "[REDACTED: ABOVE CLEARANCE]"
WITHHELD = "[redacted: content above receiving agent's clearance]"
MASKED = "[MASKED]"
CELL_PII = "[REDACTED:PII]"
CELL_ABOVE_CLEARANCE = "[REDACTED:ABOVE_CLEARANCE]"
CHUNK_SIZE = 500
CHUNK_OVERLAP = 64

# Injection patterns per layer, in report order.
INJECTION_PATTERNS = {
    "critical": (
        Pattern("ignore_previous",
                r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", True,
                hints=(("ignore",), ("instruction",))),
        Pattern("disregard_system",
                r"disregard\s+(your\s+)?(system\s+prompt|instructions?|guidelines?)", True,
                hints=(("disregard",),)),
        Pattern("new_instructions",
                r"(your\s+new|actual|real)\s+instructions?\s+(are|is|follow)", True,
                hints=(("instruction",),)),
        Pattern("jailbreak_dan", r"\bDAN\b|\bdo\s+anything\s+now\b", True,
                hints=(("dan", "anything"),)),
        Pattern("pretend_no_rules",
                r"pretend\s+(you\s+have\s+no|there\s+are\s+no)\s+"
                r"(rules?|restrictions?|limits?|guidelines?)", True,
                hints=(("pretend",),)),
        Pattern("as_root_admin",
                r"(as\s+(root|admin|superuser)|sudo\s+mode|developer\s+mode)", True,
                hints=(("root", "admin", "superuser", "mode"),)),
        Pattern("override_safety",
                r"override\s+(safety|security|policy|governance)\s+"
                r"(filter|check|control|measure)", True,
                hints=(("override",),)),
        Pattern("system_prompt_leak",
                r"(print|show|reveal|output|display)\s+(your\s+)?"
                r"(system\s+prompt|instructions?|context)", True,
                hints=(("prompt", "instruction", "context"),)),
        Pattern("token_injection", r"<\|?(system|user|assistant|im_start|im_end)\|?>", True,
                hints=(("<system", "<user", "<assistant", "<im_", "<|"),)),
        Pattern("role_switch", r"\[\s*(SYSTEM|INST|SYS)\s*\]", True,
                hints=(("[",), ("]",), ("sys", "inst"))),
    ),
    "boundary": (
        Pattern("you_are_now",
                r"you\s+are\s+now\s+(a\s+|an\s+)?(?!helpful|an? AI|an? assistant)", True,
                hints=(("you",), ("now",))),
        Pattern("forget_training",
                r"forget\s+(everything|all|your\s+training|what\s+you('ve|\s+have)\s+learned)",
                True, hints=(("forget",),)),
        Pattern("act_as", r"act\s+as\s+(if\s+you\s+are|a\s+)?(?!helpful|an? AI)", True,
                hints=(("act",),)),
        Pattern("from_now_on", r"from\s+now\s+on\s+(you\s+(will|must|should|shall)|always)", True,
                hints=(("from",), ("now",))),
        Pattern("new_persona", r"your\s+(new\s+)?(name|persona|role|identity)\s+is", True,
                hints=(("your",), ("name", "persona", "role", "identity"))),
        Pattern("hidden_instruction", r"(<!--|/\*|#\s*HIDDEN|<!--\s*instruction)", True,
                hints=(("<!--", "/*", "hidden"),)),
    ),
    "tool_redirect": (
        Pattern("call_tool", r"call\s+the\s+(tool|function|api|endpoint)\s+", True,
                hints=(("call",), ("tool", "function", "api", "endpoint"))),
        Pattern("exfil_to_url",
                r"(send|post|upload|exfiltrate)\s+(this|the|all)?\s*"
                r"(data|information|context|results?)\s+to\s+(https?://|www\.)", True,
                hints=(("http", "www."), ("data", "information", "context", "result"))),
        Pattern("write_to_db", r"(insert|update|delete|drop|truncate)\s+(into|from|table)", True,
                hints=(("insert", "update", "delete", "drop", "truncate"),
                       ("into", "from", "table"))),
        Pattern("email_data", r"(email|send)\s+.{0,30}(to|at)\s+\S+@\S+", True,
                hints=(("@",), ("email", "send"))),
        Pattern("execute_code",
                r"(exec|execute|run|eval)\s+(this\s+)?(code|script|command|sql)", True,
                hints=(("exec", "run", "eval"), ("code", "script", "command", "sql"))),
        Pattern("read_credentials",
                r"(read|access|retrieve)\s+(the\s+)?"
                r"(api\s+key|secret|password|credential|token)\s+from", True,
                hints=(("from",), ("key", "secret", "password", "credential", "token"))),
        Pattern("bypass_auth",
                r"(bypass|skip|ignore)\s+"
                r"(auth(entication|orisation)?|login|verification|the\s+proof)", True,
                hints=(("bypass", "skip", "ignore"),
                       ("auth", "login", "verification", "proof"))),
    ),
    "delimiter": (
        Pattern("triple_backtick", r"```\s*(system|instructions?|prompt)\s*\n", True,
                hints=(("```",),)),
        Pattern("xml_injection", r"<(system|instructions?|prompt|context)>", True,
                hints=(("<system", "<instruction", "<prompt", "<context"),)),
        Pattern("json_injection",
                r'"(system|instructions?|role)"\s*:\s*"(system|override|jailbreak)"', True,
                hints=(('"system"', '"override"', '"jailbreak"'),)),
    ),
}
