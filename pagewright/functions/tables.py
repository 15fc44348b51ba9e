"""Spellings that must meet, and names with what they stand for."""

from __future__ import annotations

# Cyrillic letters and their Latin spelling; я and ю stand after a consonant.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "c", "ш": "s", "щ": "s", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "u", "я": "a",
}
VOWELS, GLIDED = "аеёиоуыэюя", "яюеёи"

# Names of symbols and their glyphs, in the order in which they are offered.
SYMBOLS = (
    ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("delta", "δ"), ("epsilon", "ε"), ("varepsilon", "ε"), ("zeta", "ζ"), ("eta", "η"),
    ("theta", "θ"), ("vartheta", "θ"), ("iota", "ι"), ("kappa", "κ"), ("lambda", "λ"), ("mu", "μ"), ("nu", "ν"), ("xi", "ξ"), ("omicron", "ο"),
    ("pi", "π"), ("varpi", "π"), ("rho", "ρ"), ("varrho", "ρ"), ("sigma", "σ"), ("varsigma", "σ"), ("tau", "τ"), ("upsilon", "υ"),
    ("phi", "φ"), ("varphi", "φ"), ("chi", "χ"), ("psi", "ψ"), ("omega", "ω"),
    ("Gamma", "Γ"), ("Delta", "Δ"), ("Theta", "Θ"), ("Lambda", "Λ"), ("Xi", "Ξ"), ("Pi", "Π"), ("Sigma", "Σ"), ("Upsilon", "Υ"),
    ("Phi", "Φ"), ("Psi", "Ψ"), ("Omega", "Ω"),
    ("sum", "∑"), ("prod", "∏"), ("int", "∫"), ("oint", "∮"), ("partial", "∂"), ("nabla", "∇"), ("infty", "∞"), ("sqrt", "√"),
    ("hbar", "ħ"), ("ell", "ℓ"), ("dagger", "†"),
    ("times", "×"), ("cdot", "⋅"), ("div", "÷"), ("pm", "±"), ("mp", "∓"), ("leq", "≤"), ("le", "≤"), ("geq", "≥"), ("ge", "≥"),
    ("neq", "≠"), ("ne", "≠"), ("approx", "≈"), ("sim", "∼"), ("simeq", "≃"), ("equiv", "≡"), ("propto", "∝"), ("in", "∈"), ("notin", "∉"),
    ("subset", "⊂"), ("subseteq", "⊆"), ("cup", "∪"), ("cap", "∩"), ("forall", "∀"), ("exists", "∃"), ("land", "∧"), ("wedge", "∧"),
    ("lor", "∨"), ("vee", "∨"), ("neg", "¬"), ("otimes", "⊗"), ("oplus", "⊕"), ("perp", "⊥"), ("parallel", "∥"),
    ("to", "→"), ("rightarrow", "→"), ("longrightarrow", "→"), ("leftarrow", "←"), ("gets", "←"), ("leftrightarrow", "↔"),
    ("Rightarrow", "⇒"), ("Leftrightarrow", "⇔"), ("mapsto", "↦"), ("langle", "⟨"), ("rangle", "⟩"),
    ("ldots", "…"), ("dots", "…"), ("cdots", "…"),
)

COMMANDS = dict(SYMBOLS)
_GREEK_LETTERS = [(name, glyph) for name, glyph in SYMBOLS if "Ͱ" <= glyph <= "Ͽ"]
#: Bare names that a query may spell a Greek letter with.
GREEK = {name: glyph for name, glyph in _GREEK_LETTERS if name.islower() and not name.startswith("var")}


# Names in \\[...] and their glyphs.
NAMED = {
    "Alpha": "α", "Beta": "β", "Gamma": "γ", "Delta": "δ", "Epsilon": "ε", "CurlyEpsilon": "ε", "Zeta": "ζ", "Eta": "η", "Theta": "θ",
    "CurlyTheta": "θ", "Iota": "ι", "Kappa": "κ", "Lambda": "λ", "Mu": "μ", "Nu": "ν", "Xi": "ξ", "Omicron": "ο", "Pi": "π", "CurlyPi": "π",
    "Rho": "ρ", "CurlyRho": "ρ", "Sigma": "σ", "CurlySigma": "σ", "FinalSigma": "σ", "Tau": "τ", "Upsilon": "υ", "Phi": "φ", "CurlyPhi": "φ",
    "Chi": "χ", "Psi": "ψ", "Omega": "ω", "CapitalGamma": "Γ", "CapitalDelta": "Δ", "CapitalTheta": "Θ", "CapitalLambda": "Λ",
    "CapitalXi": "Ξ", "CapitalPi": "Π", "CapitalSigma": "Σ", "CapitalUpsilon": "Υ", "CapitalPhi": "Φ", "CapitalPsi": "Ψ", "CapitalOmega": "Ω",
    "Rule": "→", "RuleDelayed": "→", "Infinity": "∞", "PartialD": "∂", "Element": "∈", "LessEqual": "≤", "GreaterEqual": "≥",
    "NotEqual": "≠", "Times": "×", "Dagger": "†", "HBar": "ħ", "Sqrt": "√",
}

# Commands that say how a formula looks, and accents.
SILENT = frozenset(
    "left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr displaystyle textstyle scriptstyle limits nolimits "
    "mathrm mathbf mathit mathsf mathtt boldsymbol bm operatorname text textrm textit textbf textsf texttt textnormal mbox "
    "quad qquad medspace thinspace thickspace negthinspace".split()
)
ACCENTS = frozenset(
    "bar overline underline hat widehat tilde widetilde vec dot ddot acute grave check breve mathring overrightarrow overleftarrow overleftrightarrow slashed".split()
)

# Raised and lowered characters, and letters that Unicode writes in two ways.
RAISED = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"))
LOWERED = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ", "0123456789+-=()aeoxhklmnpst"))
ALIASES = {"ϵ": "ε", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϱ": "ρ", "ς": "σ", "µ": "μ", "ℏ": "ħ", "−": "-", "⟶": "→", "⟵": "←", "⋯": "…", "∙": "⋅"}

# Character classes, as they stand between brackets of a regular expression.
SPACES = r"\t-\r    -     　﻿"
LETTERS = "a-zа-я0-9"
GLYPHS = r"Ͱ-Ͽ℀-⅏←-⏿⟀-⟿⤀-⫿±×÷¬†‡…√∞ħ"
GAPS = r"    "
#: A gap within a number that is written in groups of three digits; between two addresses (1.2.3.45 208.0.0.1) there is none.
GAP = rf"(?<=(?<![0-9])(?<![0-9][.])[0-9]{{1,3}})[{GAPS}](?=[0-9]{{3}}(?![0-9])(?![.][0-9]+[.]))"
#: Whether there is anything for the formula fold to do, and whether a folded word looks like part of a formula.
TEXISH = r"[\\$^_{}~¹²³µ⁰-₟−ςϑϕϖϱϵℏ⟵⟶⋯∙]|->"
SIGNED = rf"[\\^_{{}}=+<>|]|[{GLYPHS}]|(^|[^{LETTERS}])-|-($|[^{LETTERS}])"

# Named entities of HTML that pages use.
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»",
    "hellip": "…", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "deg": "°", "times": "×", "rarr": "→", "larr": "←",
    "middot": "·", "copy": "©", "frac12": "½",
}
