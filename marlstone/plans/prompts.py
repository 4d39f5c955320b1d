"""Prompt templates (G14) of the graph, the agent, question writing, judging and retrieval; ``{name}`` marks what is filled in."""

from __future__ import annotations

import string

GRAPH = {
    "grade_document": "Question:\n{question}\n\nPassage:\n{document}\n\nCould this passage help to answer the question? Reply with JSON: {{\"score\": \"yes\"}} or {{\"score\": \"no\"}}.",
    "rewrite_question": "This question found nothing useful:\n{question}\n\nPhrase it anew so that a search finds more. Reply with the new question only, in the language of the old one.",
    "check_grounding": "Passages:\n{documents}\n\nAnswer:\n{answer}\n\nIs every claim of the answer grounded in the passages? Reply with JSON: {{\"score\": \"yes\"}} or {{\"score\": \"no\"}}.",
    "check_answer": "Question:\n{question}\n\nAnswer:\n{answer}\n\nDoes the answer resolve the question? Reply with JSON: {{\"score\": \"yes\"}} or {{\"score\": \"no\"}}.",
    "answer": "Use these passages only:\n{documents}\n\n## Question: {question}\n\nAnswer in the question's language and name the passages you used. Say so if they do not hold the answer.",
    "system": "You answer from given documents. You never invent sources, and you say when something is not in them.",
}
AGENT = {
    "need_more": "Question:\n{question}\n\nContext:\n{context}\n\nAnswer so far:\n{answer}\n\nDoes the question need facts that the context lacks? Reply with JSON: {{\"need_more\": true or false, \"reason\": \"...\"}}.",
    "select_source": "Question:\n{question}\n\nContext:\n{context}\n\nSources already used: {previous_sources}\n\nWhich source should be asked next? Reply with JSON: {{\"source\": \"...\", \"reason\": \"...\", \"query\": \"...\"}}.",
    "web_query": "Turn this question into a short query for a web search engine; reply with the query only.\n{question}",
    "merge_sources": "Question:\n{question}\n\nFrom documents:\n{context}\n\nFrom elsewhere:\n{external}\n\nAnswer the question from both, and keep them apart where they disagree.",
}
QUESTIONS = {
    "factual": "Text:\n{chunk}\n\nWrite a question that one sentence of this text answers, and that answer.",
    "analytical": "Text:\n{chunk}\n\nWrite a question that asks for reasons or consequences found in this text, and its answer.",
    "comparative": "First text:\n{chunk}\n\nSecond text:\n{other}\n\nWrite a question that compares what both say, and its answer.",
    "summarization": "Texts:\n{chunk}\n\nAsk for a summary of these texts, and write it.",
    "hallucination": "Text:\n{chunk}\n\nWrite a question on this subject that the text does not answer.",
}
QUESTION_FORMAT = "Reply with JSON: {{\"question\": \"...\", \"answer\": \"...\"}}, both in {language}."
JUDGE = {
    "faithfulness": "Context:\n{context}\n\nAnswer:\n{answer}\n\nFrom 0 to 1, what share of the answer's claims does the context support?",
    "answer_relevance": "Question:\n{question}\n\nAnswer:\n{answer}\n\nFrom 0 to 1, how directly does the answer address the question?",
    "completeness": "Question:\n{question}\n\nExpected:\n{ground_truth}\n\nContext:\n{context}\n\nAnswer:\n{answer}\n\nFrom 0 to 1, how much of what is expected does the answer cover?",
    "abstention_quality": "Question:\n{question}\n\nContext:\n{context}\n\nAnswer:\n{answer}\n\nFrom 0 to 1, how right was it to answer, or to decline?",
}
JUDGE_FORMAT = "Reply with JSON: {{\"score\": a number from 0 to 1}}."
RETRIEVAL = {
    "hyde": "Write a passage of three sentences, as a reference document would have it, that answers:\n\n## Question: {question}",
    "multi_query": "Write {n} other ways to ask this, each on a line of its own, in the same language:\n{question}",
    "contextualize": "Document:\n{document}\n\nPart of it:\n{chunk}\n\nIn one or two sentences in {language}, say where in the document this part stands and what it is about.",
}
ALL = {f"{group}.{name}": text for group, texts in (("graph", GRAPH), ("agent", AGENT), ("question", QUESTIONS), ("judge", JUDGE), ("retrieval", RETRIEVAL)) for name, text in texts.items()}


def fields(name: str) -> set[str]:
    """What a template needs."""
    return {f for _, f, _, _ in string.Formatter().parse(ALL[name]) if f}


def filled(name: str, **values: object) -> str:
    """A template with its fields, and the form of reply that questions and judges ask for."""
    if missing := fields(name) - values.keys():
        raise KeyError(f"{name} needs {', '.join(sorted(missing))}")
    text = ALL[name].format(**values)
    if name.startswith("judge."):
        return f"{text}\n{JUDGE_FORMAT.format()}"
    return f"{text}\n{QUESTION_FORMAT.format(language=values.get('language', 'English'))}" if name.startswith("question.") else text
