"""Prompt templates by language and prompt type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from choicemeter.functions.text import format_text

# The two prompt texts, white space included.  IT and ES have none.
PROMPTS = {
    ("EN", "prompt_player"): '''
                        Hi! Let's play a round of Cards Against Humanity.
                        You will be the player.
                        Card Zar personality: {character_description}
                        The Black card selected is: {black_card_text}.
                        The White cards available are: {white_cards_options}.
                        Which card do you choose? Remember that the goal is to choose the funniest one and will be judged by the zar card.
                        As a response, give me just the id of the card you choose in a format: "ID: card_id".
                        ''',
    ("EN", "prompt_judge"): '''
                        Hi! Let's play a round of Cards Against Humanity.
                        You will be the Card Zar.
                        Card Zar personality: {character_description}
                        The Black card selected is: {black_card_text}.
                        The White cards to judge are: {white_cards_options}.
                        Which card do you choose? Remember that the goal is to choose the funniest one and will be judged by the zar card.
                        As a response, give me just the id of the card you choose in a format: "ID: card_id".
                        ''',
}


def render_prompt(
    lang: Column, prompt_type: Column, fields: dict[str, Column], templates: dict[tuple[str, str], str] | None = None
) -> Column:
    """The prompt of a row; null where no template exists for its language and type."""
    chosen = F.lit(None).cast("string")
    for (known_lang, known_type), template in (templates or PROMPTS).items():
        here = (lang == known_lang) & (prompt_type == known_type)
        chosen = F.when(here, format_text(template, fields)).otherwise(chosen)
    return chosen
