"""What the model is told, by prompt name. Requests hold the data; these say what to do with it."""

from __future__ import annotations

import hashlib

PROMPTS = {
    "talk-span": (
        "You get the transcript of a recorded meeting, a line for each stretch of speech, with its time and speaker. "
        "Find the main talk. Copy its first and its last 6 to 15 words exactly as they stand, each with the time of the "
        "line in which it begins. Give the main speaker's name only if somebody says it. State how sure you are (high, "
        "medium or low), why, and anything odd."
    ),
    "fix-words": (
        "You get terms and a transcript. List places where the recognizer wrote something that sounds like a term, or a "
        "scripture reference in words: what stands there, what it should be, the line's time and why. Change nothing else."
    ),
    "clip-ideas": (
        "You get the transcript of a talk. Propose passages that stand alone as short clips. For each, copy the first and "
        "the last words exactly, with their lines' times, and write a title and a caption."
    ),
    "clip-judge": (
        "You get numbered passages, each with the words that lead into it. Judge each as a clip for people who have not "
        "heard the talk: keep or reject, one sentence why, and a score from 1 to 10."
    ),
    "texts": (
        "You get facts about a place and the transcript of a talk that was given there. Write titles, a long and a short "
        "description, chapters with times, the passage it is about, other references, tags and hashtags."
    ),
    "site": "You get the text of some pages of a website. Say what the place is called, where it is, who speaks there, and which names a recognizer may mishear.",
}


def version(name: str) -> str:
    """Eight hex digits that change with the prompt's text."""
    return hashlib.sha256(PROMPTS[name].encode()).hexdigest()[:8]
