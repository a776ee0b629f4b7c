"""Column functions: text, prompts and answers, provider configuration, errors and progress."""
