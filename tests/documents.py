"""Hand-written game documents."""

from __future__ import annotations

import json


def lineup(team, players):
    return {"team": team, "players": players}


def opening(lineups, pitchers=None):
    pregame = {"lineups": lineups}
    if pitchers is not None:
        pregame["pitchers"] = pitchers
    return {"inning": "試合前", "pregame": pregame}


def play(inning, line, result=None):
    return {"inning": inning, "plays": [{"lines": [line] if result is None else [line, result]}]}


def game(game_id, teams, runs, live):
    return {
        "url": f"https://site.example/score/{game_id}.html",
        "scoreboard": [{"team": t, "R": r} for t, r in zip(teams, runs)],
        "text_live": live,
    }


def nine(prefix):
    return [f"{prefix}{i}" for i in range(1, 10)]


def write(folder, docs):
    folder.mkdir(parents=True, exist_ok=True)
    for name, doc in docs.items():
        text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=2)
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    return str(folder)
