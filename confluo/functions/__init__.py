"""Column functions: text, dates, phones, companies, skills, confidence."""
